"""Cells, streams and lists of the distance operators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolpick.operators import neighbors as nb
from poolpick.operators import strategies as st


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, emb array<double>").repartition(3)


def costs(pool, target, metric):
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-8)[:, None]
        return -(unit(target) @ unit(pool).T)
    return np.sqrt(((target[:, None] - pool[None]) ** 2).sum(2))


def plain(pool, target, k, metric="l2"):
    d = costs(pool, target, metric)
    return {(t, r + 1): int(i) for t, row in enumerate(d) for r, i in enumerate(sorted(range(len(row)), key=lambda i: (round(row[i], 9), i))[:k])}


def listed(edges):
    return {(r.tgt_id, r.rk): r.src_id for r in edges.collect()}


def clustered(rng, n, centres, spread=0.05):
    return centres[np.arange(n) % len(centres)] + rng.normal(size=(n, centres.shape[1])) * spread


@pytest.fixture
def counted(monkeypatch):
    """Rows that enter the exchange of each search: (pool side, target side)."""
    seen, real = [], nb._stream

    def count(resident, streamed, kernel, schema):
        seen.append((resident.count(), streamed.count()))
        return real(resident, streamed, kernel, schema)

    monkeypatch.setattr(nb, "_stream", count)
    return seen


def test_cells_that_cannot_hold_a_neighbour_are_not_shuffled(spark, counted):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 10
    pool, target = clustered(rng, 2000, centres), clustered(rng, 100, centres)
    lists = nb.Neighbours(frame(spark, pool), frame(spark, target), block_bytes=8 * 8 * 50)
    assert listed(lists.edges(5)) == plain(pool, target, 5)
    (home_pool, home), (far_pool, far) = counted
    assert lists.cells is not None and len(lists.parts) == 40
    assert home_pool <= 2000 and far_pool <= 2000  # the pool crosses once a search at most
    # of 40 x 100 (cell, target) pairs only a cluster's own cells run, each with its parts of 50 rows
    assert home + far <= 100 * 2 * 4
    assert lists.computed <= 100 * 400


def test_any_cut_gives_the_same_lists(spark):
    rng = np.random.default_rng(1)
    pool, target = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    pool[::7] = pool[0]  # ties, also across parts of one cell
    target[3] = pool[0]
    target[4] = pool[0] + 1e6
    pool[5], target[6] = 0, 0
    for metric in ("l2", "cosine"):
        want = plain(pool, target, 60, metric)
        for rows, visits in ((1000, 1 << 18), (40, 1 << 18), (7, 5)):
            got = nb.Neighbours(frame(spark, pool), frame(spark, target), metric=metric, block_bytes=8 * 5 * rows, visits=visits).edges(60)
            assert listed(got) == want, (metric, rows)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_lists_go_on_where_they_ended(spark, metric):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * 8
    pool, target = clustered(rng, 600, centres), clustered(rng, 30, centres)
    pool[::50] = pool[0]
    for rows in (25, 10_000):
        lists, got = nb.Neighbours(frame(spark, pool), frame(spark, target), metric=metric, block_bytes=8 * 6 * rows), {}
        for before, k in ((0, 2), (2, 4), (4, 8), (8, 64), (64, 700)):
            new = listed(lists.extend(k))
            assert all(before < rk <= k for _, rk in new)
            got |= new
            assert got == plain(pool, target, min(k, 600), metric)


def test_a_deeper_level_leaves_listed_cells_out(spark):
    """Distances that a level measures: a level beyond a finished cluster does not visit its cells again."""
    rng = np.random.default_rng(3)
    centres = np.arange(10)[:, None] * np.full((1, 4), 50.0)
    pool = np.repeat(centres, 100, 0) + rng.normal(size=(1000, 4)) * 0.1
    target = centres[:1] + rng.normal(size=(20, 4)) * 0.1
    lists = nb.Neighbours(frame(spark, pool), frame(spark, target, 5000), block_bytes=8 * 4 * 20)
    measured, rows = [], []
    for k in (50, 100, 150, 200, 300):
        rows.append(lists.extend(k).count())
        measured.append(lists.computed)
    assert rows == [20 * 50, 20 * 50, 20 * 50, 20 * 50, 20 * 100]  # only new ranks
    # each level stays near one cluster (100 rows x 20 targets, cells may hold several pivots' rows); nothing of
    # the first cluster is measured from rank 101 on
    assert all(m <= 20 * 420 for m in measured), measured
    fresh = nb.Neighbours(frame(spark, pool), frame(spark, target, 5000), block_bytes=8 * 4 * 20)
    fresh.edges(300).count()
    assert measured[-1] < fresh.computed


def test_selection_is_the_same_for_every_cut_and_budget(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 6
    pool, target = frame(spark, clustered(rng, 400, centres, 1.0)), frame(spark, clustered(rng, 12, centres, 1.0), 1000)
    scores = pool.select("row_id", (F.pmod(F.xxhash64("row_id"), F.lit(997)) / 997).alias("uncertainty"))
    prev = st.empty_prev(spark)
    for budget in (3, 20, 90, 250):
        one = st.select_knn_uncertainty(pool, target, scores, prev, budget).collect()
        many = st.select_knn_uncertainty(pool, target, scores, prev, budget, block_bytes=8 * 5 * 30).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == budget


def test_mean_distances_of_blocks_and_streams(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pool, target = rng.normal(size=(90, 7)), rng.normal(size=(60, 7))
    p, t = frame(spark, pool), frame(spark, target, 500)
    d = costs(pool, target, "l2").T
    for blocks in (nb.BLOCK_BYTES, 8 * 7 * 11):
        for opens in (True, False):  # Arrow reads the shared folder, or the blocks go through an exchange
            monkeypatch.setattr(nb.Blocks, "open", (lambda self: True) if opens else (lambda self: False))
            got = nb.mean_distance_per_source(p, t, block_bytes=blocks).orderBy("src_id").collect()
            assert np.allclose([[r.mean_dist, r.min_dist, r.max_dist] for r in got], np.stack([d.mean(1), d.min(1), d.max(1)], 1))
            assert {r.n_tgt for r in got} == {60}
            per = nb.mean_distance_per_target(p, t, block_bytes=blocks).orderBy("tgt_id").collect()
            assert np.allclose([r.mean_dist for r in per], d.mean(0)) and {r.n_src for r in per} == {90}
    sim = nb.mean_similarity_per_source(p, t).orderBy("src_id").collect()
    assert np.allclose([r.mean_dist for r in sim], -costs(pool, target, "cosine").mean(0))


def test_rows_without_a_vector(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0, 4.0])], "row_id long, emb array<double>")
    t = spark.createDataFrame([(9, [0.0, 0.0]), (8, [None, 1.0])], "row_id long, emb array<double>")
    assert [tuple(r) for r in nb.mean_similarity_per_source(p, t).orderBy("src_id").collect()] == [(1, 0.0), (2, None), (3, None), (4, 0.0)]
    got = {r.src_id: r.mean_dist for r in nb.mean_distance_per_source(p, t).collect()}
    assert got == {1: 0.0, 2: None, 3: None, 4: 5.0}
    assert listed(nb.knn_edges(p, t, 5)) == {(9, 1): 1, (9, 2): 4}
    none = t.limit(0)
    assert nb.mean_similarity_per_source(p, none).count() == 0 and nb.Neighbours(p, none).extend(3).count() == 0
    for f in (nb.mean_similarity_per_source, nb.mean_distance_per_source, nb.knn_edges):
        with pytest.raises(Exception, match="length"):
            f(p, spark.createDataFrame([(1, [1.0])], "row_id long, emb array<double>"), *([2] if f is nb.knn_edges else [])).collect()


def test_distances_of_a_block_take_one_array(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((400, 8)), rng.standard_normal((20_000, 8))
    d = np.sqrt(((x[:5, None] - y[None]) ** 2).sum(2))
    cells = 8 * nb.BLOCK_CELLS
    tracemalloc.start()
    got = nb._sums(x, y, "l2")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[:, :5], [d.sum(1), d.min(1), d.max(1)])
    assert most < 1.5 * cells  # more than two before
