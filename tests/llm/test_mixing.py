"""Cube-method mixing: targets, exact totals, determinism, edges."""

import random

import numpy as np

from poolpick.llm import mixing as M
from .conftest import DOCS, words


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in over}


def test_targets():
    rng = random.Random(1)
    for _ in range(50):
        sizes = {f"s{i}": rng.randrange(1, 10_000) for i in range(rng.randrange(1, 9))} | ({None: 50} if rng.random() < .5 else {})
        got, want = M.water_fill(sizes), plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
        assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 2000):
        size, p = rng.integers(0, 5000, n), np.full(n, 0.37)
        got = M.flight(p, size)
        assert ((got > M.EPS) & (got < 1 - M.EPS)).sum() <= 2
        assert abs(got.sum() - p.sum()) < 1e-6 and abs(got @ size - p @ size) < 1e-3 * max(1, size.max())


def docs(spark, n=1500):
    rng = random.Random(3)
    return spark.createDataFrame([(i, words(rng, int(rng.paretovariate(1.2) * 10) % 3000), "en", rng.choice(["a", "b", "b", "b", "é", None]), 0)
                                  for i in range(n)], DOCS)


def test_mix_meets_targets_in_blocks_and_reruns_agree(spark):
    d = docs(spark)
    runs = [{r.doc_id: (r.size, r.target, r.taken, r.source) for r in M.mix(x, block_rows=rows).collect()}
            for x, rows in ((d, 20_000), (d.repartition(7), 20_000), (d, 100))]
    assert runs[0] == runs[1]
    for got in (runs[0], runs[2]):
        sizes = {}
        for r in d.collect():
            assert got[r.doc_id][0] == len(r.text.split())
            sizes[r.source] = sizes.get(r.source, 0) + got[r.doc_id][0]
        want = plain_targets(sizes)
        for s in sizes:
            mine = [v for v in got.values() if v[3] == s]
            assert abs(mine[0][1] - want[s]) < 1e-6 and abs(sum(v[2] for v in mine) - want[s]) <= 2
        assert all(t in (0, n, 2 * n) for n, _, t, _ in got.values())


def test_resample_follows_the_plan(spark):
    d = docs(spark, 300)
    d = d.unionByName(d.limit(20)).unionByName(d.limit(20))  # equal rows
    plan = {}
    for r in M.mix(d).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.copies
    out = M.resample(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def test_edges(edge_docs, no_docs):
    got = M.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert M.resample(edge_docs).columns == edge_docs.columns and M.resample(edge_docs).count() > 0
    assert M.mix(no_docs).count() == 0 and M.resample(no_docs).count() == 0
