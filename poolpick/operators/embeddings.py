"""Pooled embeddings from token states held as tables (EMB-1..4).

States arrive in long form ``(row_id, pos, h array<double>, mask)``.
Pooling groups whole vectors: MLlib's ``Summarizer`` computes the
(weighted) mean per group with map-side partial aggregation, so the
shuffle carries one buffer per group and task -- never one row per
dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cls_embedding(states: DataFrame, id_col="row_id", pos_col="pos", vec_col="h") -> DataFrame:
    """EMB-1: the state vector at position 0."""
    return states.where(F.col(pos_col) == 0).select(id_col, F.col(vec_col).alias("embedding"))


def masked_mean(states: DataFrame, mask, id_col="row_id", vec_col="h") -> DataFrame:
    """EMB-2 (attention mask) / EMB-3 (label != -100): sum(h * mask) / max(sum(mask), 1e-9)
    per row, as ``embedding array<double>``; an all-masked row pools to zeros."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    m = mask.cast("double")
    x = states.select(id_col, array_to_vector(F.transform(vec_col, lambda v: v * m)).alias("_v"), m.alias("_m"))
    g = x.groupBy(id_col).agg(Summarizer.sum(F.col("_v")).alias("_sum"), F.sum("_m").alias("_w"))
    den = F.greatest(F.col("_w"), F.lit(1e-9))
    return g.select(id_col, F.transform(vector_to_array("_sum"), lambda v: v / den).alias("embedding"))


def masked_mean_long(states: DataFrame, mask, id_col="row_id", vec_col="h") -> DataFrame:
    """EMB-2/3 in long form (row_id, dim, value), exploded only at the output."""
    return masked_mean(states, mask, id_col, vec_col).select(id_col, F.posexplode("embedding").alias("dim", "value"))


def to_vector(long: DataFrame, id_col="row_id", dim_col="dim", value_col="value", out="embedding") -> DataFrame:
    """(id, dim, value) rows -> one ordered array per id."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(dim_col).alias("d"), F.col(value_col).alias("v"))))
    return long.groupBy(id_col).agg(F.transform(pairs, lambda s: s["v"]).alias(out))


def example_mean(features: DataFrame, vec_col: str, example_col="example_id") -> DataFrame:
    """EMB-4: element-wise mean over the feature rows of each example."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    g = features.select(example_col, array_to_vector(vec_col).alias("_v")).groupBy(example_col) \
        .agg(Summarizer.mean(F.col("_v")).alias("_mean"))
    return g.select(example_col, vector_to_array("_mean").alias("embedding"))


def example_mean_long(features: DataFrame, vec_col: str, example_col="example_id") -> DataFrame:
    """EMB-4 in long form (example_id, dim, value), exploded only at the output."""
    return example_mean(features, vec_col, example_col).select(example_col,
                                                                F.posexplode("embedding").alias("dim", "value"))
