"""Distance operators between a pool and a target set.

Nearest neighbours
------------------
* The pool is cut by nearness: rows go to the nearest of some pool rows drawn by hash (pivots), and a
  table of cells keeps each pivot, the radius around it and the row count. The table is bounded by
  ``PIVOT_BYTES``; it is all that the driver holds.
* For every target the table gives an upper bound of the k-th distance, and by the triangle
  inequality a lower bound of every cell. Cells that cannot beat the bound are left out before
  anything is shuffled; what crosses the exchange is the pool once, and a target once for each cell left.
* The home cell (nearest pivot) is searched first; its k-th distance then bounds the other cells.
* Cells stream: the rows of one cell (at most ``block_bytes``) come first in their task,
  the targets that visit it follow in batches, so the targets of a cell are never held together.
  Cells visited by more than ``VISITS`` targets are dealt to several tasks.
* Lists go on: ``Neighbours.extend`` finds ranks k+1 .. 2k beyond the kept k-th
  neighbour; cells whose rows are all listed are not visited again.

Mean distances
--------------
* Every distance counts, so no cell can be left out. One side is written once to the shared folder in
  blocks of ``block_bytes``; each task of the other side streams over the blocks with its own rows in
  memory. Neither side is shuffled, and a row's result is complete in its task. (Where the
  tasks cannot open the shared folder through Arrow, blocks stream through an exchange.)
* A mean cosine similarity is the product with the mean of the unit targets: one pass over each side.

Distances that decide a rank are measured by direct differences of the pair, so results do not
depend on cells; all rows that may tie with the k-th are measured, and ties go to the smaller id.
Rows whose vector is NULL, or holds a NULL, NaN or infinite component, take no part as
neighbours or targets; per-source means are NULL for such pool rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolpick.functions.vectors import BLOCK_CELLS, arrow_matrix, block_rows, pair_dists, shifted_sq_dists, sq_dists, sq_norms, unit_rows
from poolpick.session import materialise, scratch_path

BLOCK_BYTES = 32 << 20   # vectors of one cell or block
RESIDENT_BYTES = 64 << 20  # vectors that a task of the mean distances holds while it streams over the blocks
PIVOT_BYTES = 8 << 20    # vectors of all pivots
VISITS = 1 << 18         # targets that one task takes to a cell
TOP_CELLS = 1 << 22      # targets x k of one step inside a cell
SLACK = 1e-9             # relative room of the bounds for rounding


def _finite(vec_col: str):
    return F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.where(_finite(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _side(df: DataFrame, id_col: str, vec_col: str, name: str):
    """(rows id/v written once, row count, vector length) of the usable rows."""
    x = materialise(_usable(df, id_col, vec_col), name)
    n, lo, hi = x.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n and lo != hi:
        raise ValueError(f"vectors in {vec_col} differ in length ({lo}..{hi})")
    return x, n, hi or 0


def _ids(column) -> np.ndarray:
    return np.asarray(column)


def _matrix(column) -> np.ndarray:
    return arrow_matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)


# ------------------------------------------------------------------ cells


class Cells:
    """Pivots, radii and counts of the pool's cells, and what they say about a target."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, metric: str):
        self.pivots, self.radius, self.count, self.metric = pivots, radius, count, metric

    def costs(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(to the pivot, least, largest) cost of the rows of every cell, for each target. A cost is a
        distance, or a negative similarity."""
        if self.metric == "cosine":
            to = -(unit_rows(t) @ self.pivots.T)
            room = self.radius * (1 + SLACK) + SLACK
            return to, to - room, to + room
        to = _pivot_dists(t, self.pivots)
        room = self.radius * (1 + SLACK)
        err = SLACK * (to + room) + 1e-300
        return to, to - room - err, to + room + err

    def bound(self, most: np.ndarray, k: int) -> np.ndarray:
        """A cost that at least k pool rows do not exceed (infinite if the pool is smaller)."""
        order = np.argsort(most, axis=1)
        rows = np.cumsum(self.count[order], axis=1)
        at = (rows < k).sum(1)
        out = np.full(len(most), np.inf)
        ok = at < most.shape[1]
        out[ok] = most[ok, order[ok, at[ok]]]
        return out


def _pivot_dists(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; near ones by direct differences, as bounds need every digit there."""
    d2, err = sq_dists(x, pivots)
    near = np.nonzero(d2 <= 1e6 * err)
    d = np.sqrt(d2)
    for lo in range(0, len(near[0]), BLOCK_CELLS // 16):
        i, j = (a[lo:lo + BLOCK_CELLS // 16] for a in near)
        d[i, j] = pair_dists(x[i], pivots[j])
    return d


def _batches_of(n: int, m: int):
    step = block_rows(m)
    return [(lo, min(lo + step, n)) for lo in range(0, n, step)]


def _deal_pool(pool: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """id, v, cell, far (distance to the cell's pivot) of every pool row."""
    shared = pool.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most

    def run(batches):
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            x = unit_rows(x) if metric == "cosine" else x
            cell, far = np.empty(len(x), np.int32), np.empty(len(x))
            for lo, hi in _batches_of(len(x), len(p)):
                d = _pivot_dists(x[lo:hi], p)
                cell[lo:hi] = d.argmin(1)
                far[lo:hi] = d.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(far)], ["id", "v", "cell", "far"])

    return pool.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int, far double")


_STREAM = ["cell", "part", "chunk", "side", "id", "v", "bound", "after", "after_id"]


def _stream(resident: DataFrame, streamed: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(resident ids, resident matrix, batch of streamed rows)`` inside each (cell, part, chunk).

    ``resident``: cell, part, chunk, id, v; ``streamed``: these and bound, after, after_id.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bound", "double"), ("after", "double"), ("after_id", "long"))]
    rows = resident.select("cell", "part", "chunk", F.lit(0).alias("side"), "id", "v", *none) \
        .unionByName(streamed.select("cell", "part", "chunk", F.lit(1).alias("side"), "id", "v", "bound", "after", "after_id"))
    dealt = rows.repartition("cell", "part", "chunk").sortWithinPartitions("cell", "part", "chunk", "side")

    def run(batches):
        here, ids, held = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(3)], 1)
            side = np.asarray(b.column(3))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                key, part = tuple(keys[lo]), b.slice(lo, hi - lo)
                if key != here:
                    here, ids, held = key, [], []
                if side[lo] == 0:
                    ids.append(_ids(part.column(4)))
                    held.append(_matrix(part.column(5)))
                elif held:
                    if len(held) > 1:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    yield from kernel(ids[0], held[0], part)

    return dealt.mapInArrow(run, schema)


def _kth(score: np.ndarray, place: int) -> np.ndarray:
    """The value at ``place`` of every sorted column, some columns at a time."""
    step = max(1, BLOCK_CELLS // 16 // max(1, len(score)))
    return np.concatenate([np.partition(score[:, lo:lo + step], place, axis=0)[place] for lo in range(0, score.shape[1], step)] or [np.empty(0)])


def _nearest(k: int, metric: str):
    """The k nearest rows of a cell for every target of a batch: beyond the target's last listed row, none beyond its bound."""
    names = ["tgt_id", "src_id", "dist"]

    def measure(p, t, rows, cols):
        step = BLOCK_CELLS // 16
        parts = [(-np.einsum("ij,ij->i", p[rows[s:s + step]], t[cols[s:s + step]]) if metric == "cosine" else pair_dists(p[rows[s:s + step]], t[cols[s:s + step]]))
                 for s in range(0, len(rows), step)]
        return np.concatenate(parts or [np.empty(0)])

    def run(p_id, pool, batch):
        t_id, target = _ids(batch.column(4)), _matrix(batch.column(5))
        bound, after, after_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in (6, 7, 8))
        after = np.where(np.isnan(after), -np.inf, after)  # NULL: nothing is listed yet
        p = unit_rows(pool) if metric == "cosine" else pool
        whole = unit_rows(target) if metric == "cosine" else target
        step = max(1, min(block_rows(len(p)), TOP_CELLS // max(1, min(k, len(p)))))
        for lo in range(0, len(whole), step):
            t, ids, lim, cur, cur_id = (x[lo:lo + step] for x in (whole, t_id, bound, after, after_id))
            if metric == "cosine":
                score, err = -(p @ t.T), 1e-14 * max(1, p.shape[1])
                low, top = cur, lim
            else:
                score, err = sq_dists(p, t)
                low, top = np.where(cur > 0, np.square(cur), cur), np.square(lim)
            room = 2 * err + 1e-12 * np.abs(np.where(np.isinf(low), 0, low))
            score[score < (low - room)[None]] = np.inf  # surely not beyond the last listed row
            unsure = int((score <= (low + room)[None]).sum(0).max(initial=0))
            place = k + unsure - 1
            kth = _kth(score, place) if place < len(p) else np.full(len(t), np.inf)
            # everything that may be among the next k, all ties with the k-th included
            rows, cols = np.nonzero((score <= np.minimum(kth, np.where(np.isinf(top), top, top + 1e-12 * np.abs(top)))[None] + 2 * err) & (score < np.inf))
            d = measure(p, t, rows, cols)
            beyond = (d > cur[cols]) | ((d == cur[cols]) & (p_id[rows] > cur_id[cols]))
            rows, cols, d = rows[beyond], cols[beyond], d[beyond]
            order = np.lexsort((p_id[rows], d, cols))
            rows, cols, d = rows[order], cols[order], d[order]
            keep = np.arange(len(cols)) - np.searchsorted(cols, cols) < k
            rows, cols, d = rows[keep], cols[keep], d[keep]
            for s in range(0, len(rows), 100_000):
                e = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[cols[e]]), pa.array(p_id[rows[e]]), pa.array(d[e])], names)

    return run


_EDGES = "tgt_id long, src_id long, dist double"


class Neighbours:
    """Neighbour lists between a pool and a target set, of several depths.

    ``edges(k)``: the k nearest pool rows of every target, (tgt_id, src_id, dist, rk). ``extend(k)``: only
    the ranks beyond those that earlier calls of ``extend`` have returned.
    """

    def __init__(self, pool: DataFrame, target: DataFrame, id_col: str = "row_id", vec_col: str = "emb", metric: str = "l2",
                 block_bytes: int = BLOCK_BYTES, visits: int = VISITS):
        self.pool, self.n_pool, self.dim = _side(pool, id_col, vec_col, "knn_pool")
        self.target, self.n_target, t_dim = _side(target, id_col, vec_col, "knn_target")
        if self.n_pool and self.n_target and self.dim != t_dim:
            raise ValueError(f"pool and target vectors differ in length ({self.dim}, {t_dim})")
        self.metric, self.per_task, self.spark = metric, visits, pool.sparkSession
        self.listed, self.last = 0, None  # depth of the lists so far, and their last rows (id, after, after_id)
        self.rows = max(1, block_bytes // (8 * max(1, self.dim)))
        self.cells = None
        if self.n_pool and self.n_target:
            self._cut()

    def _cut(self):
        """Pivots, cells and the table of cells."""
        wanted = min(math.ceil(self.n_pool / self.rows), max(1, PIVOT_BYTES // (8 * max(1, self.dim))))
        if wanted == 1:
            self.pool = self.pool.withColumn("cell", F.lit(0)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(math.ceil(self.n_pool / self.rows))).cast("int"))
            self.parts = [math.ceil(self.n_pool / self.rows)]
            return
        drawn = self.pool.orderBy(F.md5(F.col("id").cast("string")), "id").limit(wanted).select("v").collect()
        pivots = np.unique(np.array([r["v"] for r in drawn], np.float64), axis=0)
        pivots = unit_rows(pivots) if self.metric == "cosine" else pivots
        dealt = materialise(_deal_pool(self.pool, pivots, self.metric), "knn_cells")
        count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
            count[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
        full = count > 0
        self.parts = np.maximum(1, -(-count // self.rows)).tolist()
        self.pool = self._per_cell(dealt.select("id", "v", "cell"), "parts", dict(enumerate(self.parts))) \
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        # empty cells (pivots whose rows all went to an equal one) bound nothing
        self.cells = Cells(pivots, np.where(full, radius, -np.inf), count, self.metric)

    def _per_cell(self, rows: DataFrame, column: str, values: dict[int, int]) -> DataFrame:
        """``rows`` of the cells in ``values`` with their value; at most one row for each pivot is broadcast."""
        if len(self.parts) == 1:
            return rows.withColumn(column, F.lit(values[0]))
        return rows.join(F.broadcast(self.spark.createDataFrame([(c, int(x)) for c, x in values.items()], f"cell int, {column} int")), "cell")

    def _visits(self, targets: DataFrame, k: int, home: bool, narrow: bool = False) -> DataFrame:
        """cell, part, and the target's columns, for every cell that may hold one of its next rows up to rank k.

        ``home``: the cell of the nearest pivot only; else all but that one. ``targets``: id, v, bound, after, after_id.
        """
        shared = self.spark.sparkContext.broadcast((self.cells, np.array(self.parts)))

        def run(batches):
            cells, parts = shared.value
            full = cells.count > 0
            for b in batches:
                if not b.num_rows:
                    continue
                t = _matrix(b.column(1))
                known, after = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                for lo, hi in _batches_of(len(t), 4 * len(parts)):
                    to, least, most = cells.costs(t[lo:hi])
                    to = np.where(full, to, np.inf)
                    bound = np.minimum(cells.bound(np.where(full, most, np.inf), k), np.where(np.isnan(known[lo:hi]), np.inf, known[lo:hi]))
                    near = np.zeros(to.shape, bool)
                    near[np.arange(len(to)), to.argmin(1)] = True
                    if not home:
                        near = ~near & full & (least <= bound[:, None] + SLACK * np.abs(np.where(np.isinf(bound), 0, bound))[:, None])
                    near &= ~(most < after[lo:hi][:, None])  # all rows of the cell are listed (never where ``after`` is NaN)
                    row, cell = np.nonzero(near)
                    copies = parts[cell]
                    row, cell = np.repeat(row, copies), np.repeat(cell, copies)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                    for s in range(0, len(row), 4096):
                        e = slice(s, s + 4096)
                        at = pa.array(row[e] + lo)
                        keys = [pa.array(cell[e].astype(np.int32)), pa.array(part[e].astype(np.int32)), b.column(0).take(at)]
                        if narrow:
                            yield pa.RecordBatch.from_arrays(keys, ["cell", "part", "id"])
                        else:
                            yield pa.RecordBatch.from_arrays([*keys, b.column(1).take(at), pa.array(bound[row[e]]), b.column(3).take(at), b.column(4).take(at)],
                                                             ["cell", "part", "id", "v", "bound", "after", "after_id"])

        schema = "cell int, part int, id long" + ("" if narrow else ", v array<double>, bound double, after double, after_id long")
        return targets.select("id", "v", "bound", "after", "after_id").mapInArrow(run, schema)

    def visits(self, targets: DataFrame, k: int, home: bool) -> dict[int, int]:
        """Targets that visit each cell (rows of ``_visits`` without a vector, counted)."""
        if self.cells is None:
            return {0: self.n_target}
        rows = self._visits(targets, k, home, narrow=True).where("part = 0").groupBy("cell").agg(F.count("*").alias("n"))
        return {r["cell"]: r["n"] for r in rows.collect()}

    def _search(self, targets: DataFrame, k: int, home: bool) -> DataFrame:
        """Edges of the cells that the targets visit, up to rank k, written once."""
        of = self.visits(targets, k, home)
        self.computed += sum(n * (self.n_pool if self.cells is None else int(self.cells.count[c])) for c, n in of.items())
        if not of:
            return self.spark.createDataFrame([], _EDGES)
        if self.cells is None:
            streamed = targets.withColumn("cell", F.lit(0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts[0] - 1))))
        else:
            streamed = self._visits(targets, k, home)
        chunks = {c: max(1, -(-n // self.per_task)) for c, n in of.items()}  # cells that nobody visits have none
        streamed = self._per_cell(streamed, "chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        resident = self._per_cell(self.pool, "chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return _stream(resident, streamed, _nearest(k - self.listed, self.metric), _EDGES)

    def _next(self, k: int) -> DataFrame:
        """tgt_id, src_id, dist, rk for the ranks ``listed`` + 1 .. k."""
        self.computed = 0  # distances that this call measures
        if not self.n_pool or not self.n_target or k <= self.listed:
            return self.spark.createDataFrame([], _EDGES + ", rk long")
        none = F.lit(None)
        t = self.target.withColumn("bound", F.lit(float("inf")))
        t = t.withColumn("after", none.cast("double")).withColumn("after_id", none.cast("long")) if self.last is None else t.join(self.last, "id")
        found = self._search(t, k, home=True)
        if self.cells is not None:
            found = materialise(found, "knn_home")
            # k rows in the home cell, or beyond the listed ones as many as are missing: their last cost bounds the k-th
            kth = _ranked(found, k - self.listed).where(F.col("rk") == k - self.listed).select(F.col("tgt_id").alias("id"), F.col("dist").alias("kth"))
            t = materialise(t.join(kth, "id", "left").withColumn("bound", F.coalesce("kth", "bound")).drop("kth"), "knn_bounds")
            found = found.unionByName(self._search(t, k, home=False))
        return _ranked(found, k - self.listed).withColumn("rk", F.col("rk") + F.lit(self.listed).cast("long"))

    def edges(self, k: int) -> DataFrame:
        listed, last = self.listed, self.last
        self.listed, self.last = 0, None
        try:
            return _signed(self._next(k), self.metric)
        finally:
            self.listed, self.last = listed, last

    def extend(self, k: int) -> DataFrame:
        """The ranks beyond those of earlier calls, up to k, written once."""
        found = materialise(self._next(k), "knn_lists")
        self.last = found.where(F.col("rk") == k).select(F.col("tgt_id").alias("id"), F.col("dist").alias("after"), F.col("src_id").alias("after_id"))
        self.listed = max(self.listed, k)
        return _signed(found, self.metric)


def _ranked(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("tgt_id").orderBy("dist", "src_id")
    return edges.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


def _signed(edges: DataFrame, metric: str) -> DataFrame:
    """Costs as distances, or as similarities."""
    return edges.withColumn("dist", -F.col("dist")) if metric == "cosine" else edges


def knn_edges(pool: DataFrame, target: DataFrame, k: int, id_col: str = "row_id", vec_col: str = "emb",
              metric: str = "l2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """k nearest pool rows of every target row: (tgt_id, src_id, dist, rk).

    Ties are broken by ``src_id``; ``rk`` is 1-based. For ``metric='cosine'``
    ``dist`` holds the similarity and nearer means larger.
    """
    return Neighbours(pool, target, id_col, vec_col, metric, block_bytes).edges(k)


# ------------------------------------------------------------------ mean distances


class Blocks:
    """Rows (id, v) written once to the shared folder, in files of about ``block_bytes`` that tasks read one at a time."""

    def __init__(self, rows: DataFrame, block_bytes: int):
        spark = rows.sparkSession
        self.path = scratch_path(spark, "blocks")
        n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
        if n and lo != hi:
            raise ValueError(f"vectors differ in length ({lo}..{hi})")
        self.n, self.dim = n, hi or 0
        self.count = max(1, math.ceil(8 * n * self.dim / block_bytes))
        rows.repartition(self.count).write.parquet(self.path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files = sorted(x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
        self.rows = spark.read.schema(rows.schema).parquet(self.path)

    def open(self) -> bool:
        """Whether Arrow opens the shared folder (local, HDFS and the common object stores)."""
        try:
            _open(self.files[0]).close()
            return True
        except (OSError, pa.ArrowException, IndexError):
            return False


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return where.open_input_file(path)


def _block(uri: str) -> np.ndarray:
    from pyarrow import parquet

    with _open(uri) as f:
        return _matrix(parquet.read_table(f, columns=["v"]).column("v").combine_chunks())


def _sums(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Sum, least and largest distance of every row of x to the rows of y."""
    out = np.empty((3, len(x)))
    if metric == "cosine":
        y = unit_rows(y)
    else:  # shifted once for all batches
        mean = y.mean(axis=0)
        y = y - mean
        y_sq = sq_norms(y)
    for lo, hi in _batches_of(len(x), len(y)):
        if metric == "cosine":
            d = unit_rows(x[lo:hi]) @ y.T
        else:
            d = shifted_sq_dists(x[lo:hi] - mean, y, y_sq)[0]
            np.sqrt(d, out=d)
        out[:, lo:hi] = d.sum(axis=1), d.min(axis=1), d.max(axis=1)
        del d  # before the next one
    return out


def _row_means(rows: DataFrame, blocks: Blocks, metric: str) -> DataFrame:
    """id, s, lo, hi: sum, least and largest distance of every row (id, v) to all rows of the blocks."""
    if not blocks.open():
        return _streamed_means(rows, blocks, metric)
    files, dim = blocks.files, blocks.dim

    def flush(ids, held):
        x = np.concatenate(held)
        held.clear()
        if x.shape[1] != dim:
            raise ValueError(f"pool and target vectors differ in length ({x.shape[1]}, {dim})")
        total = None
        for uri in files:
            y = None  # one block at a time
            y = _block(uri)
            if len(y):
                now = _sums(x, y, metric)
                total = now if total is None else np.stack([total[0] + now[0], np.minimum(total[1], now[1]), np.maximum(total[2], now[2])])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), *[pa.array(c) for c in total]], ["id", "s", "lo", "hi"])

    def run(batches):
        ids, held, size = [], [], 0
        for b in batches:
            if b.num_rows:
                ids.append(_ids(b.column(0)))
                held.append(_matrix(b.column(1)))
                size += held[-1].nbytes
                if size >= RESIDENT_BYTES:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield flush(ids, held)

    return rows.select("id", "v").mapInArrow(run, "id long, s double, lo double, hi double")


def _streamed_means(rows: DataFrame, blocks: Blocks, metric: str) -> DataFrame:
    """The same through an exchange: every block is one cell, the rows stream past it."""

    def kernel(p_id, block, batch):
        s, lo, hi = _sums(_matrix(batch.column(5)), block, metric)
        yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(s), pa.array(lo), pa.array(hi)], ["id", "s", "lo", "hi"])

    zero = [F.lit(0).alias("part"), F.lit(0).alias("chunk")]
    resident = blocks.rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks.count)).cast("int").alias("cell"), *zero, "id", "v")
    streamed = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks.count - 1))).alias("cell"), *zero, "id", "v",
                           *[F.lit(None).cast(t).alias(c) for c, t in (("bound", "double"), ("after", "double"), ("after_id", "long"))])
    parts = _stream(resident, streamed, kernel, "id long, s double, lo double, hi double")
    return parts.groupBy("id").agg(F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _without_vector(pool: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return pool.where(~F.coalesce(_finite(vec_col), F.lit(False))).select(F.col(id_col).cast("long").alias("src_id"))


def mean_distance_per_source(pool: DataFrame, target: DataFrame, id_col: str = "row_id", vec_col: str = "emb",
                             metric: str = "l2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(src_id, mean_dist, min_dist, max_dist, n_tgt) over all target rows; NULL for a pool row without a usable vector."""
    blocks = Blocks(_usable(target, id_col, vec_col), block_bytes)
    if not blocks.n:
        return pool.sparkSession.createDataFrame([], "src_id long, mean_dist double, min_dist double, max_dist double, n_tgt long")
    found = _row_means(_usable(pool, id_col, vec_col), blocks, metric)
    means = found.select(F.col("id").alias("src_id"), (F.col("s") / F.lit(blocks.n)).alias("mean_dist"), F.col("lo").alias("min_dist"),
                         F.col("hi").alias("max_dist"), F.lit(blocks.n).cast("long").alias("n_tgt"))
    none = F.lit(None).cast("double")
    return means.unionByName(_without_vector(pool, id_col, vec_col).select(
        "src_id", none.alias("mean_dist"), none.alias("min_dist"), none.alias("max_dist"), F.lit(0).cast("long").alias("n_tgt")))


def mean_similarity_per_source(pool: DataFrame, target: DataFrame, id_col: str = "row_id", vec_col: str = "emb") -> DataFrame:
    """(src_id, mean_dist): mean cosine similarity to all target rows, by the mean of the unit targets."""

    def total(batches):
        s, n = None, 0
        for b in batches:
            if b.num_rows:
                u = unit_rows(_matrix(b.column(0))).sum(axis=0)
                if s is not None and len(s) != len(u):
                    raise ValueError(f"vectors in {vec_col} differ in length ({len(s)}, {len(u)})")
                s, n = u if s is None else s + u, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(np.full(len(s), n, np.int64))], ["i", "s", "n"])

    sums = _usable(target, id_col, vec_col).select("v").mapInArrow(total, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = sorted(sums.collect())  # one row for each component
    if not rows:
        return pool.sparkSession.createDataFrame([], "src_id long, mean_dist double")
    if len({r["n"] for r in rows}) > 1:
        raise ValueError(f"vectors in {vec_col} differ in length")
    mean = np.array([r["s"] / r["n"] for r in rows])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                if x.shape[1] != len(mean):
                    raise ValueError(f"pool and target vectors differ in length ({x.shape[1]}, {len(mean)})")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.einsum("ij,j->i", unit_rows(x), mean))], ["src_id", "mean_dist"])

    found = _usable(pool, id_col, vec_col).mapInArrow(run, "src_id long, mean_dist double")
    return found.unionByName(_without_vector(pool, id_col, vec_col).select("src_id", F.lit(None).cast("double").alias("mean_dist")))


def mean_distance_per_target(pool: DataFrame, target: DataFrame, id_col: str = "row_id", vec_col: str = "emb",
                             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(tgt_id, mean_dist, n_src): mean L2 from each target row to all pool rows; the pool is what is written in blocks."""
    blocks = Blocks(_usable(pool, id_col, vec_col), block_bytes)
    if not blocks.n:
        return pool.sparkSession.createDataFrame([], "tgt_id long, mean_dist double, n_src long")
    found = _row_means(_usable(target, id_col, vec_col), blocks, "l2")
    return found.select(F.col("id").alias("tgt_id"), (F.col("s") / F.lit(blocks.n)).alias("mean_dist"), F.lit(blocks.n).cast("long").alias("n_src"))


# ------------------------------------------------------------------ on neighbour lists


def best_rank(edges: DataFrame) -> DataFrame:
    """Per source: the best (smallest) neighbour rank over all targets."""
    return edges.groupBy("src_id").agg(F.min("rk").alias("best"))


def knn_candidates(edges: DataFrame, k: int) -> DataFrame:
    """Distinct pool rows that are among the k nearest of at least one target."""
    return edges.where(F.col("rk") <= k).select(F.col("src_id").alias("row_id")).distinct()


def knn_mean_scores(edges: DataFrame, src_scores: DataFrame, ks: list[int],
                    score_cols: tuple[str, ...] = ("uncertainty", "loss")) -> DataFrame:
    """Mean neighbour score per (target, k) for each k in ``ks`` from one ranked edge set.

    One grouped pass with a conditional average per k (no replication of
    the edges), then the per-k columns are turned into rows.
    """
    ks = sorted(int(k) for k in ks)
    g = edges.where(F.col("rk") <= max(ks)).join(src_scores, "src_id")
    aggs = [F.avg(F.when(F.col("rk") <= k, F.col(c))).alias(f"{c}@{k}") for k in ks for c in score_cols]
    wide = g.groupBy("tgt_id").agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("k"), *[F.col(f"`{c}@{k}`").alias(f"nn_{c}") for c in score_cols])
        for k in ks]))
    return wide.select("tgt_id", rows.alias("r")).select("tgt_id", "r.*")
