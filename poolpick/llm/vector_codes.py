"""Vector codes: product codebooks trained by Ball k-means.

Vectors are cut into equal parts; each part position has a codebook of ``ENTRIES`` entries.
A part belongs to the ball of its nearest entry: the ball's radius is the largest
distance of its parts to the entry.

1. The first round finds every part's nearest entry by a full search.
2. Later rounds know a part's last entry. Two balls are neighbours if half the distance of
   their entries is below the radius; only a neighbour can take parts over.
   - A ball whose entry and neighbours' entries did not move is stable: its parts are skipped.
   - A part nearer to its entry than half the way to the nearest neighbour lies in the
     stable core: its own distance is all that is computed.
   - The rest lies in annular rings: between half the distances to the i-th and to the next
     neighbour (in order of distance) only the first i neighbours are compared.
   All tests are on integer squared distances (D <= 2 d as D^2 <= 4 d^2), ties included,
   so each round's assignment is that of a full search with ties to the lower index.
3. A round is one pass without a shuffle: a row carries its vector, its codes and its
   distances, and the pass writes the next state. Each task adds the parts that changed their entry
   to partial sums, which travel beside the state as rows without a vector; Spark adds
   them up. The driver holds entries, sums, radii and neighbour lists: parts x entries^2.
   Only the state of the last round stays on disk.

Cases: vectors that are null, empty or hold null or non-finite components take no part; nor do vectors
of another length than the vector with the smallest id, or of a length that the parts do
not divide; rows with a null vec_id are coded but start no entry; repeated rows each count,
and equal ids start with the smaller vector first; fewer vectors than entries start as many
entries; an empty table gives an empty result; further columns are ignored; null labels
are one label. A component beyond 2^26 after scaling fails with a message.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import drop_path, fresh_path, write_out
from poolpick.llm.vectors import binary_matrix, integers, list_matrix, paired_sq_distances, sq_distances, to_binary, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 50_000  # vectors that a task works on at a time


class Balls:
    """Neighbour lists and rings of one codebook."""

    def __init__(self, entries: np.ndarray, radius: np.ndarray, moved: np.ndarray):
        """``radius``: at least the distance of every part to its entry; ``moved``: entries that changed since the parts' last look."""
        self.entries = entries
        gap = sq_distances(entries, entries)
        np.fill_diagonal(gap, np.iinfo(np.int64).max)
        reach = 4 * np.ceil(np.square(radius * (1 + 1e-9) + 1e-6))
        self.near, self.gap = [], []
        self.stable = np.zeros(len(entries), bool)
        for e in range(len(entries)):
            near = np.flatnonzero(gap[e] <= reach[e])
            near = near[np.argsort(gap[e][near], kind="stable")].astype(np.int32)
            self.near.append(near)
            self.gap.append(gap[e][near])
            self.stable[e] = not moved[e] and not moved[near].any()

    def assign(self, x: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of the parts ``x``, from their last ones."""
        code, dist = code.copy(), dist.copy()
        open_ = np.flatnonzero(~self.stable[code])
        if not len(open_):
            return code, dist
        own = paired_sq_distances(x[open_], self.entries[code[open_]])
        dist[open_] = own
        order = np.argsort(code[open_], kind="stable")
        ball = code[open_][order]
        cuts = np.flatnonzero(np.concatenate([[True], ball[1:] != ball[:-1], [True]]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            e, mine = ball[lo], order[lo:hi]
            ring = np.searchsorted(self.gap[e], 4 * own[mine], "right")  # neighbours that may be as near
            mine, ring = mine[ring > 0], ring[ring > 0]
            while len(mine):  # rings of up to 1, 2, 4, ... neighbours together
                top = min(len(self.near[e]), 1 << int(ring.min()).bit_length())
                now = ring <= top
                rivals = np.sort(np.append(self.near[e][:top], e))  # ascending, so the first least one has the lowest index
                rows = open_[mine[now]]
                d = sq_distances(x[rows], self.entries[rivals])
                best = d.argmin(1)
                code[rows], dist[rows] = rivals[best], d[np.arange(len(rows)), best]
                mine, ring = mine[~now], ring[~now]
        return code, dist


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), 8192):
        d = sq_distances(x[lo:lo + 8192], entries)
        code[lo:lo + 8192] = d.argmin(1)
        dist[lo:lo + 8192] = d.min(1)
    return code, dist


_STATE = ["vec_id", "label", "v", "code", "dist", "part", "entry", "n", "sums", "far"]
_TASK = ["part", "entry", "n", "sums", "far"]


def _schema(vec_id: str, label: str) -> str:
    return f"vec_id {vec_id}, label {label}, v binary, code binary, dist binary, part int, entry int, n long, sums array<long>, far long"


def _blocks(batches):
    """Tables of up to about ``ROWS`` rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column) -> pa.Array:
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _round(rows: DataFrame, entries: np.ndarray, balls: list[Balls] | None, schema: str) -> DataFrame:
    """The next state, and one row for each entry that a task changed or holds. ``balls``: None for a full search."""
    parts, m, width = entries.shape

    def run(batches):
        sums, n, far = np.zeros((parts, m, width), np.int64), np.zeros((parts, m), np.int64), np.full((parts, m), -1, np.int64)
        for t in _blocks(batches):
            v = binary_matrix(_flat(t["v"]), np.int32)
            old = None if balls is None else binary_matrix(_flat(t["code"]), np.uint8).astype(np.int64)
            last = None if balls is None else binary_matrix(_flat(t["dist"]), np.int64)
            code, dist = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
            for p in range(parts):
                x = v[:, p * width:(p + 1) * width]
                if balls is None:
                    code[:, p], dist[:, p] = full_search(x, entries[p])
                    moved = np.arange(len(x))
                else:
                    code[:, p], dist[:, p] = balls[p].assign(x, old[:, p], last[:, p])
                    moved = np.flatnonzero(code[:, p] != old[:, p])
                    np.subtract.at(sums[p], old[moved, p], x[moved])
                    np.subtract.at(n[p], old[moved, p], 1)
                np.add.at(sums[p], code[moved, p], x[moved])
                np.add.at(n[p], code[moved, p], 1)
                np.maximum.at(far[p], code[:, p], dist[:, p])
            none = [pa.nulls(len(v), kind) for kind in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            for at in range(0, len(v), 10_000):
                end = min(at + 10_000, len(v))
                cols = [_flat(t["vec_id"]), _flat(t["label"]), _flat(t["v"]), to_binary(code.astype(np.uint8)), to_binary(dist), *none]
                yield pa.RecordBatch.from_arrays([c.slice(at, end - at) for c in cols], _STATE)
        p, e = np.nonzero((n != 0) | (far >= 0) | (sums != 0).any(2))
        if len(p):
            blank = [pa.nulls(len(p), f.type) for f in empty]
            yield pa.RecordBatch.from_arrays(blank + [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]),
                                                      pa.array(sums[p, e].tolist(), pa.list_(pa.int64())), pa.array(far[p, e])], _STATE)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = [to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).field(c) for c in _STATE[:5]]
    return rows.mapInArrow(run, schema)


class Codebooks:
    """Entries, sums, counts and radii of all parts: (parts, entries, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.sums = np.zeros(entries.shape, object)
        self.n = np.zeros(entries.shape[:2], object)
        self.radius = np.zeros(entries.shape[:2])

    def add(self, changes: DataFrame):
        """A round's partial sums (parts x entries rows after the sum) into totals; the entries move."""
        width = self.entries.shape[2]
        total = changes.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"),
                                                     F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        self.radius[:] = 0
        for r in total.collect():
            at = r["part"], r["entry"]
            self.n[at] += r["n"]
            self.sums[at] = self.sums[at] + np.array(r["sums"], object)
            self.radius[at] = np.sqrt(max(r["far"], 0))
        before = self.entries
        used = self.n > 0
        self.entries = before.copy()
        self.entries[used] = (self.sums[used] // self.n[used][:, None]).astype(np.int64)
        shift = np.sqrt(((self.entries - before).astype(np.float64) ** 2).sum(2))
        self.radius += shift * (1 + 1e-9)  # parts stay within the old radius and the entry's way
        return [Balls(e, r, s > 0) for e, r, s in zip(self.entries, self.radius, shift)]


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
           vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes one byte")
    spark = vectors.sparkSession
    kept = vectors.where(usable(embedding)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(embedding, scale).alias("v"))
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    empty = spark.createDataFrame([], f"vec_id {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    first = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(1).select(F.size("v").alias("d")).first()
    if first is None or first["d"] % parts:
        return empty
    dim = first["d"]
    kept = kept.where(F.size("v") == dim)
    start = np.array([r["v"] for r in kept.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()], np.int64)
    books = Codebooks(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy())
    schema = _schema(id_type, label_type)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), to_binary(list_matrix(b.column(2)).astype(np.int32))], ["vec_id", "label", "v"])

    state, path, balls = kept.mapInArrow(pack, f"vec_id {id_type}, label {label_type}, v binary"), None, None
    for last in [False] * rounds + [True]:
        now = fresh_path(spark, "vector_codes")
        _round(state, books.entries, balls, schema).write.parquet(now)
        if path:
            drop_path(spark, path)
        path, rows = now, spark.read.schema(schema).parquet(now)
        state = rows.where("v IS NOT NULL").select("vec_id", "label", "v", "code", "dist")
        if not last:
            balls = books.add(rows.where("part IS NOT NULL").select(*_TASK))

    def digits(batches):
        for b in batches:
            if b.num_rows:
                dist = binary_matrix(b.column(3), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.hex() for c in b.column(2).to_pylist()], pa.string()),
                                                  pa.array(dist.sum(1))], ["vec_id", "label", "code", "error"])

    rows = write_out(state.select("vec_id", "label", "code", "dist").mapInArrow(digits, f"vec_id {id_type}, label {label_type}, code string, error long"), "codes")
    drop_path(spark, path)
    name = hashlib.sha256(",".join(str(x) for x in books.entries.ravel().tolist()).encode()).hexdigest()
    # the label's hash is a further key: the join is dealt anew, and a label of many rows can be split
    by = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    by = by.select(F.col("label").alias("__label"), "label_error", F.xxhash64("label").alias("__mark"))
    out = rows.withColumn("__mark", F.xxhash64("label")).join(by, ["__mark"]).where(F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
