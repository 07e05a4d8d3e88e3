"""Exact top-k inner products: ball-tree branch and bound per shard.

Vectors are cut by hash into shards of about ``SHARD_ROWS`` rows; queries
into blocks of about ``QUERY_ROWS``. Each (shard, query block) cell is one
task: it builds a ball tree over the shard and descends it with all its
queries at once. A node with centre ``c`` and radius ``r`` cannot hold a score
above ``q.c + |q| r``; a query leaves a subtree whose bound is below its
current k-th score, and visits the child with the larger bound first.

The k-th score is shared between shards: the queries first search one small
probe shard each, and start in every shard with that k-th score as
the bar. The bar only rejects scores strictly below it, so ties survive and
the result is exact. Cells return at most k rows a query; a window
on (query) with a group limit keeps the best.

Scores are integer inner products, computed exactly: in float64 while every
partial sum stays below 2^53, else in Python integers.

Cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows with a null id; only vectors of the query's length are
its candidates; rows with the query's own id are not its candidates; repeated
candidate rows each count; a repeated query id is searched once, with its smallest vector; fewer than k candidates: all of them; ties go to the
smaller id; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolpick.llm.common import has, write_out

K = 5
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 20_000, 2_000, 96
PROBE_SHARE = 0.5  # of a shard: rows that set the first bar
EXACT = float(1 << 53)
OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and floor(256 x) of every usable vector."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable & (F.size(embedding) > 0))
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256).cast("double")).alias("v")))


class BallTree:
    """Median splits along the axis between two far points, down to ``LEAF_ROWS``."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.rows, self.order = rows, np.arange(len(rows))
        self.nodes: list[tuple] = []  # (first, last, left, right)
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self._grow(0, len(rows), leaf)
        self.centre = np.stack(self.centre)
        self.radius = np.array(self.radius)

    def _grow(self, first: int, last: int, leaf: int) -> int:
        at = len(self.nodes)
        x = self.rows[self.order[first:last]]
        c = x.mean(0)
        away = np.sqrt(((x - c) ** 2).sum(1))
        self.nodes.append(None)
        self.centre.append(c)
        self.radius.append(float(away.max()) * (1 + 1e-9) + 1e-9)
        left = right = -1
        if last - first > leaf and away.max() > 0:
            a = x[away.argmax()]
            b = x[((x - a) ** 2).sum(1).argmax()]
            mid = (last - first) // 2
            self.order[first:last] = self.order[first:last][np.argpartition(x @ (a - b), mid)]
            left = self._grow(first, first + mid, leaf)
            right = self._grow(first + mid, last, leaf)
        self.nodes[at] = (first, last, left, right)
        return at


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued float matrices."""
    if np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * q.shape[1] < EXACT:
        return q @ rows.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    return whole(q) @ whole(rows).T


def search(qid, q, cid, rows, bar, k: int = K):
    """Best k of (score desc, id asc) per query among ``rows``; ``bar`` has the score a hit must reach."""
    tree = BallTree(rows)
    norm = np.sqrt((q ** 2).sum(1))
    bound = q @ tree.centre.T + norm[:, None] * tree.radius
    bound += np.abs(bound) * 1e-9 + 1e-6
    bar = bar.copy()
    best_s = [np.empty(0, object) for _ in qid]
    best_i = [np.empty(0, np.int64) for _ in qid]

    def visit(node: int, active: np.ndarray):
        active = active[bound[active, node] >= bar[active]]
        if not len(active):
            return
        first, last, left, right = tree.nodes[node]
        if left < 0:
            ids = tree.order[first:last]
            scores = exact_scores(q[active], rows[ids])
            for j in np.flatnonzero((scores >= bar[active][:, None]).any(1)):
                a = active[j]
                hit = np.flatnonzero((scores[j] >= bar[a]) & (cid[ids] != qid[a]))
                s = np.concatenate([best_s[a], scores[j][hit]])
                i = np.concatenate([best_i[a], cid[ids[hit]]])
                top = sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[:k]
                best_s[a], best_i[a] = s[top], i[top]
                if len(top) == k:
                    bar[a] = max(bar[a], float(s[top[-1]]) if s[top[-1]] < EXACT else np.nextafter(float(s[top[-1]]), -np.inf))
            return
        to_left = bound[active, left] >= bound[active, right]
        visit(left, active[to_left])
        visit(right, active)
        visit(left, active[~to_left])

    visit(0, np.arange(len(qid)))
    return best_s, best_i


def _cell(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        qid, cid = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        s, i = search(qid, np.stack(queries["v"].to_numpy()), cid, np.stack(rows["v"].to_numpy()), queries["bar"].to_numpy(float), k)
        return pd.DataFrame({"query_id": np.repeat(qid, [len(x) for x in i]), "vec_id": np.concatenate([*i, np.empty(0, np.int64)]).astype("int64"),
                             "score": np.array([int(v) for x in s for v in x], dtype="int64")})
    return run


def _search_cells(queries: DataFrame, rows: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """Queries go to every shard, rows to every query block; a cell's size is bounded on both sides."""
    q = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
         .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("dim", F.size("v")))
    r = (rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("dim", F.size("v")))
    return q.groupBy("dim", "shard", "block").cogroup(r.groupBy("dim", "shard", "block")).applyInPandas(_cell(k), OUT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``rows`` for every query (both: vec_id, v)."""
    rows = write_out(rows, "topk_rows")
    queries = write_out(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk_queries")
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    # probe: a bounded slice of rows gives every query a k-th score before the shards start
    share = min(1.0, PROBE_SHARE * shard_rows / max(n, 1))
    probe = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    open_ = queries.withColumn("bar", F.lit(float("-inf")))
    if shards > 1 and has(probe):
        bars = _best(_search_cells(open_, probe, 1, blocks, k), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
        # a double above 2^53 may be rounded up, so the bar steps down there
        bars = bars.withColumn("bar", F.when(F.abs("bar") < EXACT, F.col("bar")).otherwise(F.col("bar") - F.abs("bar") * 1e-15))
        open_ = queries.join(bars, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    hits = _search_cells(write_out(open_, "topk_bars"), rows, shards, blocks, k)
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
