"""Repeated line runs by prefix doubling over line-id sequences, in DataFrame functions only.

All documents, in doc_id order, are one sequence of line ids. Prefix doubling names
every window of 2^j lines (a window of 2^(j+1) is the pair of its halves' names),
and keeps the windows that occur at least twice; it ends when none does.
A name stands for the rank of a suffix's first 2^j lines: the
suffixes with one name are one interval of the suffix array.

The longest common prefixes follow by descending the powers of two. A group of
suffixes that share ``length`` lines is split by the name of their next 2^j lines;
a part of two or more goes on with ``length + 2^j``, and leaves its
earliest suffix behind, for those that share less. Each part reached is an
LCP interval: its earliest member is the first copy, and each other one starts a repeated run
of that length. So every suffix gets the longest run that also starts
earlier in the sequence, and a run of at least ``MIN_WORDS`` words is deleted: later
copies go, the first stays.

Names are 96 bits (xxhash64 and murmur3). Counts are partial aggregates joined
back by name, so a line that fills a third of the corpus is split by
skew handling and never gathered. Only windows that repeat go on from round to round.

Cases: rows that agree in doc_id and text are one document (each keeps its
text); a null doc_id sorts first; a null text stays null, an empty one empty;
lines are compared without blanks at their ends; blank lines are part of the sequence and have no words;
an empty table gives an empty result; all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import WORD, has, join_back, text_of, write_out

MIN_WORDS = 50
POS = ["doc_id", "dk", "idx"]
NAME = ["n", "m"]


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, dk (document key), idx, n, m (line name), words: one row per line."""
    lines = F.transform(F.split(text_of(docs), "\n"), lambda s: F.regexp_replace(s, "^[\\x09-\\x0D ]+|[\\x09-\\x0D ]+$", ""))
    lines = F.transform(lines, lambda s: F.struct(F.xxhash64(s).alias("n"), F.hash(s).alias("m"), F.regexp_count(s, F.lit(WORD)).alias("words")))
    t = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.posexplode(lines).alias("idx", "line"))
    return t.select(*POS, "line.n", "line.m", "line.words")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose name occurs at two positions or more."""
    twice = rows.groupBy(*NAME).agg(F.count("*").alias("c")).where("c > 1").select(*NAME)
    return join_back(rows, twice, NAME, "left_semi").select(*POS, *NAME, "words")


def doubling(lines: DataFrame) -> list[DataFrame]:
    """Repeated windows of 1, 2, 4, ... lines, as (position, name, words)."""
    lines = write_out(lines, "lines")  # texts are cut and hashed once
    level = write_out(_repeated(lines).dropDuplicates(POS), "lines_1")  # equal rows are one document
    levels = []
    while has(level):
        levels.append(level)
        step = 1 << (len(levels) - 1)
        nxt = level.select(F.col("dk").alias("dk2"), (F.col("idx") - step).alias("idx2"), F.col("n").alias("n2"), F.col("m").alias("m2"),
                           F.col("words").alias("w2"))
        pairs = (level.join(nxt, (F.col("dk") == F.col("dk2")) & (F.col("idx") == F.col("idx2")))
                 .select(*POS, F.xxhash64("n", "m", "n2", "m2").alias("a"), F.hash("n", "m", "n2", "m2").alias("b"),
                         (F.col("words") + F.col("w2")).alias("words"))
                 .withColumnsRenamed({"a": "n", "b": "m"}))
        level = write_out(_repeated(pairs), f"lines_{2 * step}")
    return levels


def repeated_runs(levels: list[DataFrame], min_words: int = MIN_WORDS) -> DataFrame | None:
    """doc_id, dk, idx, length: the longest run at each position that starts earlier too, of enough words."""
    if not levels:
        return None
    found, open_ = [], None
    for j in reversed(range(len(levels))):
        here, size = levels[j], 1 << j
        fresh = here.withColumnsRenamed({"n": "bn", "m": "bm", "words": "bw"}).select(
            *POS, F.lit(0).alias("length"), F.lit(0).cast("long").alias("gn"), F.lit(0).alias("gm"), F.lit(0).alias("gw"), "bn", "bm", "bw")
        if j + 1 < len(levels):  # those of the next level took part there
            fresh = fresh.join(levels[j + 1].select("dk", "idx"), ["dk", "idx"], "left_anti").select(*fresh.columns)
        rows = fresh
        if open_ is not None:
            nxt = here.select(F.col("dk").alias("dk2"), F.col("idx").alias("at"), F.col("n").alias("bn"), F.col("m").alias("bm"), F.col("words").alias("bw"))
            held = open_.join(nxt, (F.col("dk") == F.col("dk2")) & (F.col("idx") + F.col("length") == F.col("at")), "left").select(*fresh.columns)
            rows = rows.unionByName(held)
        rows = write_out(rows, f"runs_in_{size}")
        key = ["length", "gn", "gm", "bn", "bm"]
        parts = (rows.where("bn is not null").groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct(*POS)).alias("head"))
                 .where("c > 1").drop("c"))
        marked = join_back(rows, parts, key, "left")  # rows without a part have no head
        marked = write_out(marked.select(*fresh.columns, F.col("head").isNotNull().alias("more"),
                                         F.coalesce(F.struct(*POS).eqNullSafe(F.col("head")), F.lit(False)).alias("first")), f"runs_out_{size}")
        longer = marked.where("more").select(*POS, (F.col("length") + size).alias("length"), F.xxhash64("gn", "gm", "bn", "bm").alias("gn"),
                                             F.hash("gn", "gm", "bn", "bm").alias("gm"), (F.col("gw") + F.col("bw")).alias("gw"), "first")
        found.append(longer.where(~F.col("first") & (F.col("gw") >= min_words)).select(*POS, "length"))
        open_ = longer.drop("first").unionByName(marked.where("first OR NOT more").select(*POS, "length", "gn", "gm", "gw"))
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    return runs.groupBy(*POS).agg(F.max("length").alias("length"))


def deletions(runs: DataFrame) -> DataFrame:
    """doc_id, dk, cuts: per document the runs to delete, without those inside the run that starts one line before."""
    runs = write_out(runs, "line_runs")
    before = runs.select(F.col("dk").alias("dk2"), (F.col("idx") + 1).alias("at"), (F.col("idx") + F.col("length")).alias("upto"))
    outer = runs.join(before, (F.col("dk") == F.col("dk2")) & (F.col("idx") == F.col("at")) & (F.col("upto") >= F.col("idx") + F.col("length")), "left_anti")
    return outer.groupBy("doc_id", "dk").agg(F.collect_list(F.struct(F.col("idx").alias("s"), (F.col("idx") + F.col("length")).alias("e"))).alias("cuts"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the text, and ``__lines``, ``__removed``."""
    runs = repeated_runs(doubling(line_table(docs)), min_words)
    lines = F.split("text", "\n")
    if runs is None:
        return docs.withColumns({"__lines": F.size(lines).cast("long"), "__removed": F.lit(0).cast("long")})
    cuts = write_out(deletions(runs), "line_cuts").select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk"), F.col("cuts").alias("__cuts"))
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    # merge at every size: the cuts grow with the corpus, and texts are dealt once
    keyed = keyed.join(cuts.hint("merge"), (F.col("__key") == F.col("__dk")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    kept = F.filter(lines, lambda _, i: ~F.exists("__cuts", lambda c: (i >= c["s"]) & (i < c["e"])))
    left = F.when(F.col("__cuts").isNull(), lines).otherwise(kept)
    return (keyed.withColumn("__lines", F.size(lines).cast("long")).withColumn("__left", left)
            .withColumn("__removed", F.col("__lines") - F.size("__left"))
            .withColumn("text", F.when(F.col("__removed") > 0, F.array_join("__left", "\n")).otherwise(F.col("text")))
            .select(*docs.columns, "__lines", "__removed"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` with later copies deleted; texts that lose every line go; n_chars follows the text."""
    out = dedup(docs, min_words)
    out = out.where("__removed IS NULL OR __removed = 0 OR __removed < __lines")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
