"""Table preparation: tagging, reshaping, filters, subsets, splits, dedupe (PRJ-*, FLT-*, SUB-*, DED-*, SET-1).

Per-language work happens on ONE table with a ``language`` column, never
one scan per language. Skew: a single language (or one duplicated text)
may hold a large share of the rows, so

* first-N-per-language uses ``row_number() <= N``, which Spark plans as a
  ``WindowGroupLimit`` -- every map task keeps at most N rows per
  language before the shuffle, so no reducer receives more than
  N x (map tasks) rows of a hot language;
* dedupe is a grouped ``min(row_id)`` with map-side partial aggregation
  (a hot duplicate collapses to one row per map task), followed by a
  semi join on the unique ``(key, row_id)`` pair;
* exact hash-order splits find their cut point from a histogram of hash
  prefixes instead of sorting the table into one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from poolpick.operators.strategies import hash_key

ID = "row_id"


# ------------------------------------------------------------------ tagging
def add_language(df: DataFrame, language: str | None = None, default: str = "unknown") -> DataFrame:
    """PRJ-1: constant language column; or keep an existing one, defaulting NULLs."""
    if language is not None:
        return df.withColumn("language", F.lit(language))
    if "language" in df.columns:
        return df.withColumn("language", F.coalesce(F.col("language"), F.lit(default)))
    return df.withColumn("language", F.lit(default))


def require_language(df: DataFrame) -> DataFrame:
    if "language" not in df.columns:
        raise ValueError("table must carry a 'language' column")
    return df


def drop_raw_columns(df: DataFrame, raw: list[str] | None, keep: list[str]) -> DataFrame:
    """PRJ-2: drop the listed raw columns; ``raw=None`` drops every column not in ``keep``."""
    if raw is None:
        return df.select(*keep)
    return df.drop(*raw)


# ------------------------------------------------------------------ reshaping
def pair_languages(pair: Column | str) -> tuple[Column, Column]:
    """PRJ-4: 'SRC-tgt' -> (src, tgt), lower-cased."""
    p = F.split(F.lower(F.col(pair) if isinstance(pair, str) else pair), "-")
    return p.getItem(0), p.getItem(1)


def translation_record(df: DataFrame, src_col="source", tgt_col="target", pair_col="language") -> DataFrame:
    """Build the raw record ``map<lang, text>`` from two text columns and a 'src-tgt' pair."""
    s, t = pair_languages(pair_col)
    return df.withColumn("translation", F.map_from_arrays(F.array(s, t), F.array(F.col(src_col), F.col(tgt_col))))


def recast_direct(df: DataFrame, pair_col="language", rec_col="translation") -> DataFrame:
    """PRJ-3c: (source, target) straight from the translation record."""
    s, t = pair_languages(pair_col)
    return df.withColumn("pair", F.struct(F.element_at(F.col(rec_col), s).alias("source"),
                                          F.element_at(F.col(rec_col), t).alias("target")))


def recast_custom(df: DataFrame, src_col: str | None, tgt_col: str | None) -> DataFrame:
    """PRJ-3d: custom columns; a NULL or empty target becomes ''."""
    if not src_col or not tgt_col:
        raise ValueError("custom source/target columns must be given")
    return df.withColumn("pair", F.struct(F.col(src_col).alias("source"),
                                          F.coalesce(F.nullif(F.col(tgt_col), F.lit("")), F.lit("")).alias("target")))


def _first_occurrence(df: DataFrame, key: Column, order_col: str = ID) -> DataFrame:
    """Flag the first row (lowest ``order_col``) of every key value.

    The flag is joined back on the unique (key, row) pair, so a key shared
    by a third of the rows still spreads over every reducer.
    """
    keyed = df.withColumn("_k", key)
    firsts = keyed.groupBy("_k").agg(F.min(order_col).alias(order_col)).withColumn("_is_first", F.lit(True))
    return keyed.join(firsts, ["_k", order_col], "left") \
        .withColumn("_is_first", F.coalesce(F.col("_is_first"), F.lit(False)))


def recast_blank_dups(df: DataFrame, pair_col="language", rec_col="translation") -> DataFrame:
    """PRJ-3a: blank the pair to ('','') when the target text is missing or the
    source text was seen on an earlier row (global scope; row count kept)."""
    s, t = pair_languages(pair_col)
    src, tgt = F.element_at(F.col(rec_col), s), F.element_at(F.col(rec_col), t)
    x = df.withColumn("_src", src).withColumn("_tgt", tgt)
    x = _first_occurrence(x, dedupe_key(F.col("_src")))
    blank = F.col("_tgt").isNull() | ~F.col("_is_first")
    out = x.withColumn("pair", F.when(blank, F.struct(F.lit("").alias("source"), F.lit("").alias("target")))
                       .otherwise(F.struct(F.col("_src").alias("source"), F.col("_tgt").alias("target"))))
    return out.drop("_src", "_tgt", "_is_first", "_k")


def recast_first_pairs(df: DataFrame, src_col="source", tgt_col="target") -> DataFrame:
    """PRJ-3b: sentence columns, a repeated source keeps only its first row."""
    return dedupe(df, src_col).withColumn("pair", F.struct(F.col(src_col).alias("source"),
                                                           F.col(tgt_col).alias("target")))


def resolve_pair_config(requests: DataFrame, configs: DataFrame, req_col="request",
                        cfg_col="config") -> DataFrame:
    """PRJ-4: lower-case and split a requested pair; use the 'src-tgt' config, else the
    reverse 'tgt-src' one when only that exists (NULL when neither)."""
    s, t = pair_languages(req_col)
    r = requests.select(req_col, s.alias("src"), t.alias("tgt"))
    c = configs.select(F.lower(F.col(cfg_col)).alias("_c")).distinct()
    fwd = c.select(F.col("_c").alias("_fwd"))
    rev = c.select(F.col("_c").alias("_rev"))
    j = r.join(fwd, F.concat_ws("-", "src", "tgt") == F.col("_fwd"), "left") \
        .join(rev, F.concat_ws("-", "tgt", "src") == F.col("_rev"), "left")
    return j.select(req_col, "src", "tgt", F.coalesce("_fwd", "_rev").alias("config"),
                    (F.col("_fwd").isNull() & F.col("_rev").isNotNull()).alias("reversed"))


def lang_from_id(id_col: str | Column = "id") -> Column:
    """PRJ-5: '<lang>-...' -> '<lang>'."""
    return F.substring_index(F.col(id_col) if isinstance(id_col, str) else id_col, "-", 1)


def strip(c: Column) -> Column:
    """Strip leading/trailing whitespace (all whitespace, not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_inputs(df: DataFrame, text_cols: list[str], int_cols: list[str]) -> DataFrame:
    """PRJ-6: texts cast to string and stripped (NULL -> ''), labels cast to int."""
    out = df
    for c in text_cols:
        out = out.withColumn(c, F.coalesce(strip(F.col(c).cast(StringType())), F.lit("")))
    for c in int_cols:
        out = out.withColumn(c, F.col(c).cast("int"))
    return out


# ------------------------------------------------------------------ filters
def rows_per_language(df: DataFrame) -> DataFrame:
    """FLT-1 in one pass: row count per language value."""
    return df.groupBy("language").agg(F.count("*").alias("n"))


def id_contains_counts(df: DataFrame, langs: list[str], id_col="id") -> DataFrame:
    """FLT-2: rows whose id CONTAINS each language code (substring, not equality).

    One pass with a conditional count per code, then codes as rows.
    """
    aggs = [F.count_if(F.col(id_col).contains(l)).alias(l) for l in langs]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(l).alias("lang"), F.col(f"`{l}`").alias("n"))
                                           for l in langs])).alias("r")).select("r.*")


def filter_configs(configs: DataFrame, prefix: str | None = None, allowed: list[str] | None = None,
                   must_contain: str | None = None, col: str = "config") -> DataFrame:
    """FLT-3: keep configs with a prefix, both pair sides in an allowed list, containing a code."""
    c = F.col(col)
    cond = F.lit(True)
    if prefix:
        cond = cond & c.startswith(prefix)
    if allowed:
        s, t = pair_languages(c)
        cond = cond & s.isin(allowed) & t.isin(allowed)
    if must_contain:
        cond = cond & c.contains(must_contain)
    return configs.where(cond)


# ------------------------------------------------------------------ subsets
def first_n_per_language(df: DataFrame, n: int, order_col: str = ID, lang_col: str = "language") -> DataFrame:
    """SUB-1/SUB-2: the first N rows (by ``order_col``) of every language."""
    w = Window.partitionBy(lang_col).orderBy(F.col(order_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def validation_fallback(df: DataFrame, n: int, split_col="split", lang_col="language",
                        order_col: str = ID) -> DataFrame:
    """SUB-3: languages without validation rows get the first N train rows as validation.

    Train is not reduced, so the two splits overlap (as in the reference).
    """
    heads = first_n_per_language(df.where(F.col(split_col) == "train"), n, order_col, lang_col)
    # the heads are N rows a language at most, so no hot language meets the join
    has_val = df.where(F.col(split_col) == "validation").select(lang_col).distinct()
    extra = heads.join(has_val, lang_col, "left_anti").withColumn(split_col, F.lit("validation"))
    return df.unionByName(extra)


def _under(prefix: str) -> Column:
    return F.lit(True) if not prefix else F.substring("_h", 1, len(prefix)) == prefix


def hash_cut(df: DataFrame, n: int, key: Column, digits: int = 4, exact_rows: int = 100_000):
    """Locate the n smallest values of ``key`` (a hex string) without a global sort.

    A histogram over the next ``digits`` hex digits (at most 16^digits
    groups, collected) finds the bucket holding the n-th key; all earlier
    buckets are inside. The crossing bucket is refined on the following
    digits until it holds at most ``exact_rows`` rows. Returns
    ``(pred, bucket_prefix, bucket_need)``: rows with ``pred`` on ``_h``
    are inside, plus the first ``bucket_need`` rows (by key) whose key
    starts with ``bucket_prefix``.
    """
    k = df.select(key.alias("_h"))
    prefix, need, conds = "", n, []
    while need > 0:
        nxt = F.substring("_h", len(prefix) + 1, digits)
        hist = sorted((r["p"], r["n"]) for r in
                      k.where(_under(prefix)).groupBy(nxt.alias("p")).agg(F.count("*").alias("n")).collect())
        total = sum(c for _, c in hist)
        if need >= total:
            conds.append(_under(prefix))
            return reduce(lambda a, b: a | b, conds), None, 0
        acc = 0
        for p, c in hist:
            if acc + c >= need:
                break
            acc += c
        conds.append(_under(prefix) & (nxt < p))
        need -= acc
        prefix += p
        if c <= exact_rows or len(prefix) + digits > 32:
            break
    pred = reduce(lambda a, b: a | b, conds) if conds else F.lit(False)
    return pred, (prefix if need > 0 else None), need


def smallest_by_hash(df: DataFrame, n: int, seed: int | str = 42, id_col: str = ID) -> DataFrame:
    """Exactly the ``n`` rows with the smallest md5('<seed>:<id>') keys (ties by id).

    The table is never ordered as a whole: a histogram pass finds the cut
    and only the one crossing bucket (bounded) is ordered and limited.
    """
    key = hash_key(seed, id_col)
    pred, bucket, need = hash_cut(df, n, key)
    k = df.withColumn("_h", key)
    inside = k.where(pred)
    if bucket is not None:
        inside = inside.unionByName(k.where(_under(bucket)).orderBy("_h", id_col).limit(need))
    return inside.drop("_h")


def hash_split(df: DataFrame, test_size: float = 0.2, seed: int | str = 42, id_col: str = ID,
               names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """SUB-4: exact seeded split -- the ceil(test_size * n) rows with the smallest
    md5 keys form the second split. Assignment does not depend on layout, and
    needs no join: a predicate on the key, plus a broadcast of the ids of the
    one bounded crossing bucket."""
    n = df.count()
    key = hash_key(seed, id_col)
    pred, bucket, need = hash_cut(df, math.ceil(test_size * n), key)
    k = df.withColumn("_h", key)
    held = pred
    if bucket is not None:
        ids = k.where(_under(bucket)).orderBy("_h", id_col).limit(need) \
            .select(F.col(id_col), F.lit(True).alias("_b"))
        k = k.join(F.broadcast(ids), id_col, "left")
        held = pred | F.col("_b").isNotNull()
    out = k.withColumn("split", F.when(held, F.lit(names[1])).otherwise(F.lit(names[0])))
    return out.drop("_h", *(["_b"] if bucket is not None else []))


def sample_k(df: DataFrame, k: int, seed: int | str = 42, id_col: str = ID) -> DataFrame:
    """SUB-5: uniform sample of min(k, n) rows without replacement (md5 order)."""
    return df.orderBy(hash_key(seed, id_col), F.col(id_col)).limit(k)


# ------------------------------------------------------------------ dedupe
def dedupe_key(c: Column) -> Column:
    """Shuffle key for exact-duplicate detection on long text: (sha-256, length).

    Hashing keeps the shuffle at 40 bytes per row however long the text;
    non-string (e.g. array) keys are compared whole. NULL is a value like any other.
    """
    return F.struct(F.sha2(c, 256).alias("h"), F.length(c).alias("n"))


def dedupe(df: DataFrame, col: str, order_col: str = ID) -> DataFrame:
    """DED-1/DED-2: exact dedupe on a column, first row (lowest ``order_col``) wins.

    Partial aggregation collapses hot duplicates map-side; the semi join
    back is keyed on the unique (key, row_id) pair, so it cannot skew.
    """
    is_str = isinstance(df.schema[col].dataType, StringType)
    key = dedupe_key(F.col(col)) if is_str else F.struct(F.col(col).alias("v"))  # a struct is never NULL, so NULL keys match
    keyed = df.withColumn("_k", key)
    firsts = keyed.groupBy("_k").agg(F.min(order_col).alias(order_col))
    return keyed.join(firsts, ["_k", order_col], "left_semi").drop("_k")


def union_languages(frames: list[DataFrame]) -> DataFrame:
    """SET-1: concatenate per-language tables (columns matched by name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
