"""Substring theta join: which passages occur inside which texts, as equi joins.

``docs.join(passages, contains(text, passage))`` plans as a nested loop. A
passage that occurs in a text brings its inner words (those with white space
of the passage on both sides) as whole words of the text. So each passage is keyed by
its longest inner word, texts are cut into distinct words, and the two meet on the
word; only such pairs are confirmed with ``instr``. A passage without an
inner word is keyed by its first ``GRAM`` characters (or all, if shorter), and meets
the texts' distinct character runs of that length; that side is
built only if there are such passages. Nothing is broadcast by force or collected.
Output: one row per (passage, text) with the first occurrence's character offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 8
_SPACE = r"\s+"


def find_passages(texts: DataFrame, passages: DataFrame, text_id: str = "doc_id", text_col: str = "text",
                  passage_id: str = "item_id", passage_col: str = "text") -> DataFrame:
    """(passage_id, text_id, start): every passage found in every text, first occurrence (0-based).

    NULL texts and NULL passages match nothing; an empty passage matches every text at 0.
    """
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(text_id).cast("long").alias("_t"), F.col(text_col).alias("_text"))
    pieces = F.split(F.col(passage_col), _SPACE)
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    longest = F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    p = passages.where(F.col(passage_col).isNotNull()).select(F.col(passage_id).cast("long").alias("_p"), F.col(passage_col).alias("_passage"),
                                                              longest.alias("_word"))
    worded = p.where(F.col("_word").isNotNull())
    words = t.select("_t", F.explode(F.array_distinct(F.split("_text", _SPACE))).alias("_word"))
    pairs = words.join(worded, "_word").select("_t", "_p")
    rest = p.where(F.col("_word").isNull()).withColumn("_n", F.least(F.length("_passage"), F.lit(GRAM)))
    sizes = sorted(r["_n"] for r in rest.select("_n").distinct().collect())  # at most GRAM + 1 values
    for n in sizes:
        some = rest.where(F.col("_n") == n)
        if n == 0:
            grams = t.select("_t", F.lit("").alias("_gram"))
        else:
            places = F.sequence(F.lit(1), F.greatest(F.length("_text") - n + 1, F.lit(1)))
            grams = t.select("_t", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col("_text"), i, F.lit(n))))).alias("_gram"))
        keyed = some.select("_p", F.substring("_passage", 1, n).alias("_gram"))
        pairs = pairs.unionByName(grams.join(keyed, "_gram").select("_t", "_p"))
    found = pairs.join(t, "_t").join(p.select("_p", "_passage"), "_p")
    at = F.instr(F.col("_text"), F.col("_passage"))
    return found.withColumn("_at", at).where("_at > 0").select(
        F.col("_p").alias(passage_id), F.col("_t").alias(text_id), (F.col("_at") - 1).cast("long").alias("start"))
