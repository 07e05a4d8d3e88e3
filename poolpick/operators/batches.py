"""User batch functions (UDF-1 on ``mapInArrow``, UDF-2 on ``mapInPandas``).

A scorer is created once per task (``make_model`` runs inside the task,
so a model is loaded once per partition, not per row) and applied to each
Arrow batch as one matrix taken from the batch's values buffer. Only the
columns the function needs cross into Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.functions.vectors import arrow_matrix


def linear_scorer(weights: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model factory: logits = X @ W."""
    w = np.asarray(weights, dtype=np.float64)

    def make():
        return lambda x: x @ w

    return make


def score_batches(df: DataFrame, make_model, id_col: str = "row_id", vec_col: str = "emb",
                  out_col: str = "logits") -> DataFrame:
    """UDF-1: (id, vector) -> (id, logits array<double>) with one model per task."""

    def run(batches):
        model = make_model()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            logits = np.asarray(model(arrow_matrix(rb.column(vec_col))), dtype=np.float64)
            n, c = logits.shape
            offsets = pa.array(np.arange(0, n * c + 1, c, dtype=np.int32))
            values = pa.ListArray.from_arrays(offsets, pa.array(logits.ravel()))
            yield pa.RecordBatch.from_arrays([rb.column(id_col).cast(pa.int64()), values], names=[id_col, out_col])

    return df.select(F.col(id_col).cast("long").alias(id_col), vec_col) \
        .mapInArrow(run, f"{id_col} long, {out_col} array<double>")


def map_batches(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str,
                remove_columns: list[str] | None = None, **bound) -> DataFrame:
    """UDF-2: apply ``fn(batch, **bound)`` to every Arrow batch; ``remove_columns`` are dropped first."""
    f = partial(fn, **bound)
    src = df.drop(*(remove_columns or []))

    def run(batches):
        for pdf in batches:
            yield f(pdf)

    return src.mapInPandas(run, schema)
