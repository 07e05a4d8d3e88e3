"""Selection strategies: brute-force restatements, edge frames and properties."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolpick.operators import neighbors as nb
from poolpick.operators import strategies as st


def _pool(spark, vecs, langs=None, unc=None):
    rows = []
    for i, v in enumerate(vecs):
        rows.append((i, (langs[i] if langs else "xx"), [float(x) for x in v],
                     None if unc is None else float(unc[i])))
    return spark.createDataFrame(rows, "row_id long, language string, emb array<double>, uncertainty double")


def _prev(spark, ids):
    return spark.createDataFrame([(int(i), n) for n, i in enumerate(ids)], "row_id long, prev_order long")


def _sel(df):
    return [r["row_id"] for r in df.orderBy("rank").collect()]


def knn_doubling_loop(pool, tgt, unc, prev, budget, k0, cap=None):
    """Restatement of the doubling rule: grow k until prev + candidates exceed the budget
    or k exceeds the neighbour-list width; then most uncertain candidates first."""
    d = np.sqrt(((tgt[:, None, :] - pool[None, :, :]) ** 2).sum(-1))
    order = np.array([np.lexsort((np.arange(len(pool)), row)) for row in d])
    width = min(cap, len(pool)) if cap else len(pool)
    order = order[:, :width]
    k = k0
    while True:
        cand = set(order[:, :k].ravel().tolist())
        if len(set(prev) | cand) > budget or k > width:
            break
        k *= 2
    ranked = sorted(cand, key=lambda i: (unc[i], i))
    out = list(prev)
    for i in ranked:
        if len(out) == budget:
            break
        if i not in out:
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_knn_uncertainty_matches_doubling_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n_pool, n_tgt, dim = int(rng.integers(8, 40)), int(rng.integers(1, 6)), 3
    pool = rng.normal(size=(n_pool, dim))
    tgt = rng.normal(size=(n_tgt, dim))
    unc = rng.random(n_pool)
    budget = int(rng.integers(1, n_pool + 3))
    prev = sorted(rng.choice(n_pool, size=int(rng.integers(0, min(3, budget) + 1)), replace=False).tolist())
    k0 = int(rng.integers(1, 4))
    cap = [None, 4][seed % 2]
    want = knn_doubling_loop(pool, tgt, unc, prev, budget, k0, cap)
    p = _pool(spark, pool, unc=unc)
    t = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(tgt)],
                              "row_id long, emb array<double>")
    got = _sel(st.select_knn_uncertainty(p.drop("uncertainty"), t, p.select("row_id", "uncertainty"),
                                         _prev(spark, prev), budget, k0=k0, max_neighbors=cap))
    assert got == want


def test_knn_edges_blocks_agree(spark):
    rng = np.random.default_rng(7)
    p = _pool(spark, rng.normal(size=(60, 4)))
    t = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(9, 4)))],
                              "row_id long, emb array<double>")
    one = nb.knn_edges(p, t, 5).orderBy("tgt_id", "rk").collect()
    many = nb.knn_edges(p, t, 5, block_bytes=200).orderBy("tgt_id", "rk").collect()  # many blocks on both sides, with bounds
    assert [(r.tgt_id, r.src_id, r.rk) for r in one] == [(r.tgt_id, r.src_id, r.rk) for r in many]
    m1 = nb.mean_distance_per_source(p, t).orderBy("src_id").collect()
    m2 = nb.mean_distance_per_source(p, t, block_bytes=200).orderBy("src_id").collect()
    assert [round(a.mean_dist, 9) for a in m1] == [round(b.mean_dist, 9) for b in m2]


def test_uncertainty_ties_break_by_row_id_and_nulls_last(spark):
    df = spark.createDataFrame([(5, 0.1), (2, 0.1), (9, None), (1, 0.3), (3, 0.1)], "row_id long, uncertainty double")
    assert _sel(st.select_uncertainty(df, st.empty_prev(spark), 5)) == [2, 3, 5, 1, 9]


def test_prev_comes_first_and_is_not_repeated(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "row_id long, uncertainty double")
    got = _sel(st.select_uncertainty(df, _prev(spark, [7, 3]), 5))
    assert got == [7, 3, 0, 1, 2]


def test_random_budget_above_pool_takes_everything(spark):
    p = _pool(spark, np.zeros((4, 2)))
    assert _sel(st.select_random(p, _prev(spark, [2]), 10)) == [0, 1, 2, 3]


def test_random_is_md5_order(spark):
    p = _pool(spark, np.zeros((30, 2)))
    want = sorted(range(30), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:7]
    assert _sel(st.select_random(p, st.empty_prev(spark), 7, seed=42)) == want


def test_egalitarian_with_zero_quota_equals_random(spark):
    langs = [f"l{i % 6}" for i in range(60)]
    p = _pool(spark, np.zeros((60, 2)), langs=langs)
    e = _sel(st.select_egalitarian(p, st.empty_prev(spark), 5))
    r = _sel(st.select_random(p, st.empty_prev(spark), 5))
    assert e == r


def test_egalitarian_quota_small_languages_whole_and_unique(spark):
    langs = ["a"] * 40 + ["b"] * 40 + ["c"] * 3
    p = _pool(spark, np.zeros((83, 2)), langs=langs)
    sel = st.select_egalitarian(p, _prev(spark, [0]), 30).join(p.select("row_id", "language"), "row_id")
    ids = [r.row_id for r in sel.collect()]
    assert len(ids) == len(set(ids)) == 30
    by = {r.language: r.n for r in sel.groupBy("language").agg(F.count("*").alias("n")).collect()}
    assert by["c"] == 3                  # small language taken whole
    assert by["a"] >= 9 and by["b"] >= 9  # quota floor(29 / 3) each, then filled


def test_allocated_quota_above_language_size_is_capped(spark):
    langs = ["ar"] * 3 + ["bn"] * 10 + ["te"] * 5
    p = _pool(spark, np.zeros((18, 2)), langs=langs)
    lines = spark.createDataFrame([("demo:cfg\titer_1\tar:5,bn:3,zz:4",), ("demo:cfg\titer_2\tte:2",)], "value string")
    alloc = st.parse_allocation(lines)
    sel = st.select_allocated(p, alloc, "demo", "cfg", 1).join(p.select("row_id", "language"), "row_id")
    by = {r.language: r.n for r in sel.groupBy("language").agg(F.count("*").alias("n")).collect()}
    assert by == {"ar": 3, "bn": 3}


def test_knn_level_rule_is_strict():
    levels = st.knn_levels(1, 4, 100)
    assert levels == [1, 2, 4, 8]
    # 4 candidates at level 4 with budget 4 is not "more than the budget": go to 8
    assert st.knn_level_for_budget({0: 1, 1: 1, 2: 2, 3: 5}, levels, 0, 4, 100) == 8
    assert st.knn_level_for_budget({0: 1, 1: 1, 2: 3}, levels, 0, 4, 100) == 4


def _vecs(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, emb array<double>")


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_ties_are_complete_in_any_layout(spark, partitions, metric):
    ids = np.random.default_rng(3).permutation(5000) + 1
    p = spark.createDataFrame([(int(i), [1.0, 2.0]) for i in ids], "row_id long, emb array<double>").repartition(partitions)
    t = _vecs(spark, [[1.0, 2.5], [0.0, 1.0]], 10_000)
    for block in (nb.BLOCK_BYTES, 4000):
        got = nb.knn_edges(p, t, 2, metric=metric, block_bytes=block).orderBy("tgt_id", "rk").collect()
        assert [(r.tgt_id, r.src_id) for r in got] == [(10_000, 1), (10_000, 2), (10_001, 1), (10_001, 2)]


def test_distances_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3000, 20)) + 1e8, rng.normal(size=(20, 20)) + 1e8
    true = np.sqrt(((y[:, None, :] - x[None, :, :]) ** 2).sum(2))
    got = {r.tgt_id - 5000: r.src_id for r in nb.knn_edges(_vecs(spark, x), _vecs(spark, y, 5000), 1).collect()}
    assert [got[i] for i in range(20)] == true.argmin(1).tolist()
    mean = {r.src_id: r.mean_dist for r in nb.mean_distance_per_source(_vecs(spark, x), _vecs(spark, y)).collect()}
    assert np.allclose([mean[i] for i in range(3000)], true.mean(0), rtol=1e-6)


def test_zero_and_bad_vectors_are_defined(spark):
    p = _vecs(spark, [[0.0, 0.0], [1.0, 0.0], [float("nan"), 1.0], [-1.0, 0.0]]).unionByName(
        spark.createDataFrame([(9, None)], "row_id long, emb array<double>"))
    t = _vecs(spark, [[2.0, 0.0]], 100)
    near = nb.knn_edges(p, t, 5, metric="cosine").orderBy("rk").collect()
    assert [(r.src_id, r.dist) for r in near] == [(1, 1.0), (0, 0.0), (3, -1.0)]
    assert _sel(st.select_average_dist(p, t, st.empty_prev(spark), 5, metric="cosine")) == [1, 0, 3, 2, 9]
    assert _sel(st.select_average_dist(p, t, st.empty_prev(spark), 3)) == [1, 0, 3]


def test_empty_sides(spark):
    p, none = _vecs(spark, [[1.0, 2.0]]), _vecs(spark, [[1.0]]).limit(0)
    for a, b in ((p, none), (none, p), (none, none)):
        assert nb.knn_edges(a, b, 3).count() == 0 and nb.mean_distance_per_target(a, b).count() == 0
        assert nb.mean_distance_per_source(a, b).count() == 0


def test_many_targets_match_direct_distances(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(20_000, 3))
    got = {(r.tgt_id, r.rk): r.src_id for r in nb.knn_edges(_vecs(spark, x), _vecs(spark, y, 1000), 2, block_bytes=64_000).collect()}
    d = ((y[:, None, :] - x[None, :, :]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    assert len(got) == 40_000 and all(got[1000 + i, j + 1] == order[i, j] for i in range(0, 20_000, 37) for j in (0, 1))


def test_allocation_keys_listed_twice_count_once(spark):
    p = _pool(spark, np.zeros((6, 1)))
    lines = spark.createDataFrame([("d:c\titer_1\ten:2",), ("d:c\titer_1\ten:2",)], "value string")
    lang = p.select("row_id").withColumn("language", F.lit("en"))
    assert len(_sel(st.select_allocated(lang, st.parse_allocation(lines), "d", "c", 1))) == 2


def test_large_budget_top_n_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vals = rng.random(3000)
    vals[::17] = 0.5  # ties at many places
    df = spark.createDataFrame([(i, float(v) if i % 101 else None) for i, v in enumerate(vals)],
                               "row_id long, uncertainty double").repartition(5)
    want = _sel(st.select_uncertainty(df, st.empty_prev(spark), 900))
    monkeypatch.setattr(st, "TOPN_DIRECT_MAX", 10)
    assert _sel(st.select_uncertainty(df, st.empty_prev(spark), 900)) == want
    p = _pool(spark, np.zeros((3000, 1)))
    r_small = _sel(st.select_random(p, st.empty_prev(spark), 700))
    monkeypatch.setattr(st, "TOPN_DIRECT_MAX", 10_000)
    assert _sel(st.select_random(p, st.empty_prev(spark), 700)) == r_small
