"""Integer vectors as bytes: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 26  # largest integer component: squared distances then stay inside 64 bits
EXACT = float(1 << 52)


def usable(embedding: str) -> Column:
    """Neither null nor empty, and no component null or non-finite."""
    v = F.col(embedding)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(embedding: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; beyond LIMIT the query fails with a message."""
    wide = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("long")
    return F.transform(F.col(embedding).cast("array<double>"),
                       lambda x: F.when(F.abs(x) * scale < LIMIT, F.floor(x * scale)).otherwise(wide))


def list_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list<long> column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def binary_matrix(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equal lengths as a matrix of ``kind``."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def to_binary(matrix: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(matrix).tobytes()
    step = matrix.shape[1] * matrix.itemsize
    return pa.array([raw[i * step:(i + 1) * step] for i in range(len(matrix))], pa.binary())


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows ``x`` to integer rows ``c``."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4.0 * x.shape[1] * float(top) ** 2 < EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", xf, xf)[:, None] - 2.0 * (xf @ cf.T) + np.einsum("ij,ij->i", cf, cf)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        out[:, j] = ((x - c[j]) ** 2).sum(1)
    return out


def paired_sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of row i of ``x`` to row i of ``c``."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def summed(rows: DataFrame, keys: list[str], sums: str, count: str, width: int) -> dict[tuple, tuple[int, list[int]]]:
    """key -> (count, summed vector) of partial rows; as many entries as there are centroids."""
    total = rows.groupBy(*keys).agg(F.sum(count).alias("c"), F.array(*[F.sum(F.col(sums)[i]) for i in range(width)]).alias("v"))
    return {tuple(r[k] for k in keys): (r["c"], r["v"]) for r in total.collect()}
