"""Language lookups and language-level distances (JOIN-7/11, FLT-5, AGG-11/12).

The code map is a small literal (bounded by the number of languages) and
is applied with ``element_at`` on a map literal -- no join. Pairwise
centroid distances join per-language centroid vectors, so the work is
languages^2 x dims, independent of the row count.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 639 two-letter -> three-letter codes for the languages of
# the embedding fixture ('xx' has no entry on purpose).
CODE_MAP = {
    "ar": "ara", "bn": "ben", "en": "eng", "fi": "fin", "id": "ind",
    "ko": "kor", "ru": "rus", "sw": "swa", "te": "tel",
}


def code_map_column(mapping: dict[str, str] = CODE_MAP) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])


def map_code(lang: Column, mapping: dict[str, str] = CODE_MAP) -> Column:
    """JOIN-11: code lookup; a missing code gives NULL."""
    return F.element_at(code_map_column(mapping), lang) if mapping else F.lit(None)


def known_languages(df: DataFrame, lang_col: str = "language", mapping: dict[str, str] = CODE_MAP) -> DataFrame:
    """FLT-5: keep rows whose language has a code."""
    return df.where(F.map_contains_key(code_map_column(mapping), F.col(lang_col)))


def lang_pairs(langs: DataFrame, lang_col: str = "language", mapping: dict[str, str] = CODE_MAP) -> DataFrame:
    """JOIN-7: ordered pairs (src, tgt), src <> tgt, of languages that have a code.

    Input is reduced to its distinct known languages first (bounded by the
    code map), so the pair product is at most |map|^2.
    """
    l = known_languages(langs.select(lang_col).distinct(), lang_col, mapping)
    a = l.select(F.col(lang_col).alias("src"))
    b = l.select(F.col(lang_col).alias("tgt"))
    return a.join(F.broadcast(b), F.col("src") != F.col("tgt"))


def centroids(df: DataFrame, lang_col: str = "language", vec_col: str = "emb") -> DataFrame:
    """Per-language mean vector (language, centroid); whole vectors are aggregated, partially in each task."""
    x = df.where(F.col(vec_col).isNotNull()).select(F.col(lang_col).alias("language"), array_to_vector(F.col(vec_col)).alias("v"))
    return x.groupBy("language").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def centroid_distances(cent: DataFrame) -> DataFrame:
    """AGG-12: pairwise L2 and cosine distance (1 - cosine similarity) of language centroids,
    long form (src, tgt, metric, value). One row per language pair, as the result has."""
    a = cent.select(F.col("language").alias("src"), F.col("centroid").alias("a"))
    b = cent.select(F.col("language").alias("tgt"), F.col("centroid").alias("b"))
    j = a.join(b, F.col("src") != F.col("tgt"))
    total = lambda x, y, f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda acc, v: acc + v)
    dot = lambda x, y: total(x, y, lambda u, v: u * v)
    l2 = F.sqrt(total("a", "b", lambda u, v: (u - v) * (u - v)))
    cos = 1 - dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    return j.select("src", "tgt", F.explode(F.array(
        F.struct(F.lit("l2").alias("metric"), l2.alias("value")),
        F.struct(F.lit("cosine").alias("metric"), cos.alias("value")))).alias("r")).select("src", "tgt", "r.*")


def min_distance(dist: DataFrame, lower: float = 0.05, upper: float = 2.0, exclude: str = "en",
                 metrics: list[str] | None = None) -> DataFrame:
    """AGG-11: per (language, metric) the nearest other language with lower < value < upper,
    target not ``exclude``; ties go to the smaller target code. Wide: one column pair per metric."""
    d = dist.where((F.col("value") > lower) & (F.col("value") < upper) & (F.col("tgt") != exclude))
    best = d.groupBy("src", "metric").agg(F.min_by(F.struct("tgt", "value"), F.struct("value", "tgt")).alias("b"))
    metrics = metrics or sorted(r[0] for r in dist.select("metric").distinct().collect())
    w = best.groupBy("src").pivot("metric", metrics).agg(F.first("b"))
    cols = []
    for m in metrics:
        cols += [F.col(f"`{m}`.tgt").alias(f"{m}_language"), F.col(f"`{m}`.value").alias(f"{m}_value")]
    return w.select(F.col("src").alias("language"), *cols)
