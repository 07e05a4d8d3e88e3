"""Ball-tree search against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from poolpick.llm import topk_search as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        mine = min(v for i, v in usable if i == q)
        score = sorted(((-sum(a * b for a, b in zip(mine, v)), i) for i, v in usable if i != q and len(v) == len(mine)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return out


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("score", F.lit(1)).withColumn("bar", F.lit(2))
    usable = K.quantised(df)
    return sorted(map(tuple, K.top_k(usable.where("vec_id % 50 = 0"), usable, **sizes).collect()))


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=d).astype(np.float32)]) for i in range(n)]


def test_equals_brute_force_over_shards_and_blocks(spark):
    rows = vectors(900, 8)
    want = plain(rows, K.K)
    assert run(spark, rows) == want
    assert run(spark, rows, shard_rows=100, query_rows=5) == want


def test_ties_repeats_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + vectors(40, 2, 1)[1:]
    rows += [(600, None), (601, []), (602, [1.0, None, 2.0]), (603, [float("nan"), 1.0, 1.0]), (604, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 0.5]),
             (700, [1.0, 2.0, 0.5]), (700, [1.0, 2.0, 0.5])]
    assert run(spark, rows) == plain(rows, K.K)
    assert run(spark, rows, shard_rows=50, query_rows=2) == plain(rows, K.K)


def test_few_candidates_and_large_numbers(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6 + 1, 3.0]), (2, [2e6, 1e6])]
    assert run(spark, rows) == plain(rows, K.K)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_bound_holds_for_every_node():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(500, 16)) * 256)
    q = np.floor(rng.normal(size=(20, 16)) * 256)
    tree = K.BallTree(rows, 16)
    top = q @ tree.centre.T + np.sqrt((q ** 2).sum(1))[:, None] * tree.radius
    for i, (first, last, _, _) in enumerate(tree.nodes):
        assert ((q @ rows[tree.order[first:last]].T).max(1) <= top[:, i] + 1e-6).all()
