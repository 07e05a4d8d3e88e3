"""2-D projection of embeddings for plots (ML-1, SET-3/4).

MLlib's PCA finds the components; it does not centre on transform and their signs are arbitrary. Here
vectors are centred by the mean of the fitted rows, and each component is turned so that
its largest loading is positive (the first of equal ones), so the same rows give the same picture.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Projection:
    """Mean of the fitted vectors and unit components, one row each."""

    mean: np.ndarray
    components: np.ndarray

    def column(self, vec: Column, c: int) -> Column:
        """(vec - mean) . component c, inside the JVM."""
        row = self.components[c]
        weights = F.array(*[F.lit(float(x)) for x in row])
        dot = F.aggregate(F.zip_with(vec, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return dot - F.lit(float(self.mean @ row))


def signed(components: np.ndarray) -> np.ndarray:
    """Components whose largest loading (in absolute value, the first of equal ones) is positive."""
    at = np.abs(components).argmax(axis=1)
    return components * np.where(components[np.arange(len(components)), at] < 0, -1.0, 1.0)[:, None]


def fit_pca(fit_on: DataFrame, vec_col: str = "emb", k: int = 2) -> Projection:
    v = fit_on.where(F.col(vec_col).isNotNull()).select(array_to_vector(vec_col).alias("features"))
    mean = v.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(v)
    return Projection(mean.toArray(), signed(model.pc.toArray().T))


def project(model: Projection, df: DataFrame, id_col: str = "row_id", vec_col: str = "emb", tag: str | None = None) -> DataFrame:
    x = df.where(F.col(vec_col).isNotNull())
    out = x.select(id_col, model.column(F.col(vec_col), 0).alias("x"), model.column(F.col(vec_col), 1).alias("y"))
    return out.withColumn("type", F.lit(tag)) if tag else out


def tagged_projection(model: Projection, parts: dict[str, DataFrame], id_col: str = "row_id", vec_col: str = "emb") -> DataFrame:
    """SET-3: projected point sets in one frame, tagged with their set name."""
    frames = [project(model, df, id_col, vec_col, tag) for tag, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
