"""List-valued transforms on token arrays of any origin (CHK-1..6).

All are row-local higher-order functions or ``explode``; none shuffles.
A token is described by its character span ``struct<s:int, e:int>``
(end exclusive); NULL marks a position outside the context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = -100


def window_starts(n_tokens: Column, window: int, overlap: int) -> Column:
    """Start offsets of overlapping windows: 0, w-o, 2(w-o), ... until the end is covered."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be in [0, window)")
    return F.sequence(F.lit(0), F.greatest(n_tokens - overlap, F.lit(1)) - 1, F.lit(window - overlap))


def chunk_windows(df: DataFrame, tokens_col: str, window: int, overlap: int, id_col: str = "row_id") -> DataFrame:
    """CHK-1: one feature row per window, carrying the example id, window index and start."""
    toks = F.col(tokens_col)
    wins = F.transform(window_starts(F.size(toks), window, overlap),
                       lambda s: F.struct(s.alias("start"), F.slice(toks, s + 1, window).alias("window")))
    x = df.select(id_col, F.posexplode(wins).alias("win", "w"))  # exploded rows hold one window each
    return x.select(id_col, "win", "w.start", "w.window")


def fixed_offsets(start_tok: Column, n_tok: Column, width: int, text_len: Column) -> Column:
    """Character spans of tokens ``start_tok .. start_tok+n_tok-1`` for a fixed-width tokeniser."""
    return F.transform(F.sequence(start_tok, start_tok + n_tok - 1),
                       lambda p: F.struct((p * width).alias("s"), F.least((p + 1) * width, text_len).alias("e")))


def span_labels(offsets: Column, ans_start: Column, ans_end: Column) -> Column:
    """CHK-2: (start, end) token positions covering the char span [ans_start, ans_end)
    when it lies fully inside the window, else (0, 0)."""
    idx = F.transform(offsets, lambda o, i: F.struct(o["s"].alias("s"), o["e"].alias("e"), i.alias("i")))
    live = F.filter(idx, lambda o: o["s"].isNotNull())
    first_s = F.array_min(F.transform(live, lambda o: o["s"]))
    last_e = F.array_max(F.transform(live, lambda o: o["e"]))
    inside = (first_s <= ans_start) & (last_e >= ans_end)
    start = F.array_max(F.transform(F.filter(live, lambda o: o["s"] <= ans_start), lambda o: o["i"]))
    end = F.array_min(F.transform(F.filter(live, lambda o: o["e"] >= ans_end), lambda o: o["i"]))
    return F.when(inside, F.struct(start.alias("start_positions"), end.alias("end_positions"))) \
        .otherwise(F.struct(F.lit(0).alias("start_positions"), F.lit(0).alias("end_positions")))


def mask_offsets(offsets: Column, sequence_ids: Column, context_id: int = 1) -> Column:
    """CHK-3: NULL the offsets of positions that are not part of the context (both lists are equally long)."""
    return F.zip_with(offsets, sequence_ids, lambda o, s: F.when(s == context_id, o))


def align_labels(df: DataFrame, word_col: str = "word_id", label_col: str = "word_label",
                 id_col: str = "row_id", pos_col: str = "pos") -> DataFrame:
    """CHK-4: word labels onto sub-tokens: the first piece of a word gets its label,
    continuation pieces and special tokens (NULL word) get -100."""
    w = Window.partitionBy(id_col).orderBy(pos_col)
    prev = F.lag(word_col).over(w)
    first_piece = F.col(word_col).isNotNull() & (prev.isNull() | (prev != F.col(word_col)))
    return df.withColumn("aligned", F.when(first_piece, F.col(label_col)).otherwise(F.lit(MASK)).cast("int"))


def pad_truncate(arr: Column, max_len: int, pad) -> Column:
    """CHK-5: cut to ``max_len`` or pad with ``pad`` up to it."""
    cut = F.slice(arr, 1, max_len)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))))


def unmask(arr: Column, pad_id: int) -> Column:
    """CHK-6: -100 -> pad id before decoding."""
    return F.transform(arr, lambda x: F.when(x == MASK, F.lit(pad_id)).otherwise(x))


def ordered_list(df: DataFrame, id_col: str, pos_col: str, value_col: str, out: str) -> DataFrame:
    """Long (id, pos, value) -> one array per id in position order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(value_col).alias("v"))))
    return df.groupBy(id_col).agg(F.transform(pairs, lambda s: s["v"]).alias(out))
