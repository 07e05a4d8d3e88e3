"""Centroid clustering over a VA-file: few-bit cells bound every distance, vectors are fetched only when bounds overlap.

1. The kept vectors are written once, bucketed by a row key, with an approximation beside
   them: every dimension is cut into 64 cells, evenly over 2.8 deviations on either side of its
   mean, the outer ones up to its least and largest value. A cell takes 6 bits and is kept in a byte.
2. A round scans the approximations alone. For every centroid, lookup tables give
   the least and the largest squared distance that a cell adds; a
   sum of one look-up a dimension is an interval around the distance. Centroids whose interval
   reaches below the smallest upper end stay; a vector with one such centroid is
   settled.
3. Full vectors are fetched by the row key for the others, and for those that
   changed their centroid, as only they change sums and counts. The vectors are
   bucketed by that key, so the fetch shuffles the narrow side only. In the first
   round and for the final distances every vector is due: there one pass reads
   approximation and vector of a row together, without a join.
4. Sums and counts are integers and are added by Spark; centroids (k x dimensions) are the
   driver's only data. Cells are integer ranges, so intervals are exact and ties go to
   the smaller number as in a plain search.

Cases: vectors that are null, of another length, or with null or non-finite components take no
part; rows with a null vec_id are clustered but never start a centroid; repeated rows
each count, and equal hashes start with the smaller vector first; fewer vectors than k start as many
centroids; an empty table gives an empty result; further columns are ignored.
A component beyond 2^26 after scaling fails with a message, as 64-bit distances end there.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import fresh_path, has, split_count, write_out
from poolpick.llm.vectors import binary_matrix, integers, list_matrix, paired_sq_distances, sq_distances, summed, to_binary, usable

K, DIM, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
CELLS, SPREAD = 64, 2.8  # cells of a dimension (6 bits), deviations that the inner ones cover


def kept_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (integers) of the vectors that take part."""
    return (vectors.where(usable(embedding) & (F.size(embedding) == dim))
            .select(F.col(vec_id).alias("vec_id"), integers(embedding, scale).alias("v")))


def starts(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest sha256 of '<seed>:<vec_id>'."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Cells:
    """Cell bounds of every dimension: cell c of dimension j holds the integers low[j, c] .. high[j, c]."""

    def __init__(self, marks: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.marks = marks  # dim x (CELLS - 1), ascending: first integer of the next cell
        self.low = np.concatenate([least[:, None], marks], 1)
        self.high = np.concatenate([marks - 1, most[:, None]], 1)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """The cell of every component."""
        cell = np.empty(v.shape, np.uint8)
        for j in range(v.shape[1]):
            cell[:, j] = np.searchsorted(self.marks[j], v[:, j], "right")
        return cell

    def lookup(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance that a cell adds, for every centroid: (dim, cells, k)."""
        c = centroids.T[:, None, :]  # dim, 1, k
        low, high = self.low[:, :, None], self.high[:, :, None]
        return np.maximum(np.maximum(low - c, c - high), 0) ** 2, np.maximum(np.abs(c - low), np.abs(high - c)) ** 2


def cut_cells(kept: DataFrame) -> Cells:
    """Marks from sums, squares, least and largest components over all vectors."""

    def partial(batches):
        n, acc = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            v = list_matrix(b.column(0))
            f = v.astype(np.float64)
            now = [f.sum(0), (f * f).sum(0), v.min(0), v.max(0)]
            acc = now if acc is None else [acc[0] + now[0], acc[1] + now[1], np.minimum(acc[2], now[2]), np.maximum(acc[3], now[3])]
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc[0]), dtype=np.int32)), pa.array(np.full(len(acc[0]), n, np.int64)),
                                              *[pa.array(x) for x in acc]], ["dim", "n", "s", "q", "lo", "hi"])

    parts = kept.select("v").mapInArrow(partial, "dim int, n long, s double, q double, lo long, hi long")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    rows.sort(key=lambda r: r["dim"])
    n, s, q = (np.array([r[c] for r in rows], np.float64) for c in ("n", "s", "q"))
    mean = s / n
    dev = np.sqrt(np.maximum(q / n - mean ** 2, 0))
    places = np.linspace(-SPREAD, SPREAD, CELLS - 1)
    lo, hi = (np.array([r[c] for r in rows], np.int64) for c in ("lo", "hi"))
    # marks stay inside the values, so that every cell's ends bound what it holds
    marks = np.clip(np.ceil(mean[:, None] + dev[:, None] * places).astype(np.int64), lo[:, None], hi[:, None] + 1)
    return Cells(marks, lo, hi)


class Intervals:
    """Distance intervals of code rows, for one set of centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.least, self.most = cells.lookup(centroids)

    def overlapping(self, codes: np.ndarray) -> np.ndarray:
        """rows x k: may the centroid be the nearest?"""
        low = np.zeros((len(codes), self.least.shape[2]), np.int64)
        high = np.zeros_like(low)
        for j in range(codes.shape[1]):
            low += self.least[j][codes[:, j]]
            high += self.most[j][codes[:, j]]
        return low <= high.min(1)[:, None]


def nearest(v: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest of the centroids that ``may`` leaves a row; ties to the smaller number."""
    out = may.argmax(1)
    several = np.flatnonzero(may.sum(1) > 1)
    for lo in range(0, len(several), 50_000):
        at = several[lo:lo + 50_000]
        d = sq_distances(v[at], centroids)
        d[~may[at]] = np.iinfo(np.int64).max
        out[at] = d.argmin(1)
    return out


class _Sums:
    """Sums and counts by cluster of one task."""

    def __init__(self, k: int, dim: int):
        self.v, self.n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)

    def add(self, cluster: np.ndarray, v: np.ndarray, sign: int = 1):
        for c in np.unique(cluster[cluster >= 0]):
            mine = cluster == c
            self.v[c] += sign * v[mine].sum(0, dtype=np.int64)
            self.n[c] += sign * int(mine.sum())


_STATE = "key long, code binary, cluster int, n long, sums array<long>"


def _state_rows(key, code, cluster) -> pa.RecordBatch:
    none = pa.nulls(len(cluster), pa.int64())
    return pa.RecordBatch.from_arrays([key, code, pa.array(cluster.astype(np.int32)), none, pa.nulls(len(cluster), pa.list_(pa.int64()))],
                                      ["key", "code", "cluster", "n", "sums"])


def _sum_rows(sums: _Sums) -> pa.RecordBatch:
    """Rows without a key: a task's sums travel beside its state, so one pass and one written table serve both."""
    c = np.flatnonzero((sums.n != 0) | (sums.v != 0).any(1))
    return pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.binary()), pa.array(c.astype(np.int32)), pa.array(sums.n[c]),
                                       pa.array(sums.v[c].tolist(), pa.list_(pa.int64()))], ["key", "code", "cluster", "n", "sums"])


def _first_round(full: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        bounds, sums = Intervals(cells, centroids), _Sums(*centroids.shape)
        for b in batches:
            if b.num_rows:
                v = binary_matrix(b.column(2), np.int32)
                cluster = nearest(v, bounds.overlapping(binary_matrix(b.column(1), np.uint8)), centroids)
                sums.add(cluster, v)
                yield _state_rows(b.column(0), b.column(1), cluster)
        yield _sum_rows(sums)

    return write_out(full.select("key", "code", "v").mapInArrow(run, _STATE), "va_state")


def _scan(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """key, code, old, cluster (-1: intervals overlap), may: from the approximations alone."""

    def run(batches):
        bounds = Intervals(cells, centroids)
        for b in batches:
            if b.num_rows:
                may = bounds.overlapping(binary_matrix(b.column(1), np.uint8))
                cluster = np.where(may.sum(1) == 1, may.argmax(1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cluster), to_binary(np.packbits(may, 1))],
                                                 ["key", "code", "old", "cluster", "may"])

    return write_out(state.select("key", "code", "cluster").mapInArrow(run, "key long, code binary, old int, cluster int, may binary"), "va_scan")


def _fetch(due: DataFrame, full: DataFrame, centroids: np.ndarray) -> DataFrame:
    """State and changes of the sums for rows whose intervals overlap or whose centroid changed."""

    def run(batches):
        sums = _Sums(*centroids.shape)
        for b in batches:
            if b.num_rows:
                v = binary_matrix(b.column(4), np.int32)
                may = np.unpackbits(binary_matrix(b.column(3), np.uint8), 1)[:, :len(centroids)].astype(bool)
                old, cluster = np.asarray(b.column(2)), nearest(v, may, centroids)
                moved = old != cluster
                sums.add(old[moved], v[moved], -1)
                sums.add(cluster[moved], v[moved])
                yield _state_rows(b.column(0), b.column(1), cluster)
        yield _sum_rows(sums)

    rows = due.select("key", "code", "old", "may").hint("merge").join(full.select("key", "v"), "key")
    return write_out(rows.mapInArrow(run, _STATE), "va_fetched")


def _moved(sums: dict, rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Adds a round's changes to ``sums`` (cluster -> [count, vector]); the new centroids."""
    for (c,), (n, v) in summed(rows, ["cluster"], "sums", "n", centroids.shape[1]).items():
        sums[c] = [sums[c][0] + n, [a + b for a, b in zip(sums[c][1], v)]]
    return np.array([[x // n for x in v] if n else centroids[c].tolist() for c, (n, v) in sorted(sums.items())], np.int64)


def _final(full: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    kind = full.schema["vec_id"].dataType.simpleString()

    def run(batches):
        bounds = Intervals(cells, centroids)
        for b in batches:
            if b.num_rows:
                v = binary_matrix(b.column(2), np.int32)
                cluster = nearest(v, bounds.overlapping(binary_matrix(b.column(1), np.uint8)), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(paired_sq_distances(v, centroids[cluster]))],
                                                 ["vec_id", "cluster", "distance"])

    return write_out(full.select("vec_id", "code", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "va_clusters")


def cluster(kept: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector (``kept``: vec_id, v of one length)."""
    spark = kept.sparkSession
    kind = kept.schema["vec_id"].dataType.simpleString()
    kept = write_out(kept, "va_vectors")
    centroids = starts(kept, k, seed)
    if not len(centroids) or not has(kept):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    cells = cut_cells(kept)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                v = list_matrix(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), to_binary(cells.encode(v)), to_binary(v.astype(np.int32))], ["key", "vec_id", "code", "v"])

    packed = kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", "v").mapInArrow(pack, f"key long, vec_id {kind}, code binary, v binary")
    name, buckets = f"va_file_{uuid.uuid4().hex}", split_count(spark)
    packed.repartition(buckets, "key").write.option("path", fresh_path(spark, "va_file")).bucketBy(buckets, "key").sortBy("key").saveAsTable(name)
    try:
        full = spark.table(name)
        sums = {c: [0, [0] * centroids.shape[1]] for c in range(len(centroids))}
        state = None
        for _ in range(rounds):
            if state is None:
                rows = _first_round(full, cells, centroids)
                state = rows.where("key IS NOT NULL").select("key", "code", "cluster")
            else:
                scan = _scan(state, cells, centroids)
                rows = _fetch(scan.where("cluster <> old"), full, centroids)
                state = scan.where("cluster = old").select("key", "code", "cluster").unionByName(rows.where("key IS NOT NULL").select("key", "code", "cluster"))
            centroids = _moved(sums, rows.where("key IS NULL").select("cluster", "n", "sums"), centroids)
        out = _final(full, cells, centroids)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    by = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    info = spark.createDataFrame([(c, by[c], sum(by.values()), names[c]) for c in sorted(by)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
