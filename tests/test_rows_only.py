"""Brute-force checks for the queries that have no SQL oracle."""

import numpy as np

import __spark_entry__ as E
from poolpick import fixtures as fx
from poolpick.operators.projection import fit_pca, project
from tests.conftest import SF_SMALL

Q = E.queries()


def test_pca_matches_numpy_svd_up_to_sign(spark):
    pool, tgt = fx.pool_df(spark, SF_SMALL), fx.target_df(spark, SF_SMALL)
    both = pool.unionByName(tgt)
    model = fit_pca(both)
    got = {r.row_id: (r.x, r.y) for r in project(model, both).collect()}
    rows = sorted((r.row_id, r.emb) for r in both.collect())
    x = np.array([e for _, e in rows])
    xc = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    want = xc @ vt[:2].T
    g = np.array([got[i] for i, _ in rows])
    for c in range(2):
        sign = np.sign(np.dot(g[:, c], want[:, c]))
        assert np.allclose(g[:, c], sign * want[:, c], atol=1e-6)


def test_pca_project_tags_each_set(spark):
    out = Q["pca_project"](spark, SF_SMALL)
    counts = {r.type: r["count"] for r in out.groupBy("type").count().collect()}
    assert counts["selected"] == fx.FLAGSHIP_BUDGET and counts["source"] == 100 and counts["target"] == 50


def test_refit_rounds_are_disjoint_and_cumulative(spark):
    r = Q["al_rounds_refit"](spark, SF_SMALL).collect()
    ids = [x.row_id for x in r]
    assert len(ids) == len(set(ids)) == 60
    assert sorted(x["rank"] for x in r) == list(range(1, 61))
    by_round = {}
    for x in r:
        by_round.setdefault(x["round"], []).append(x["rank"])
    assert sorted(by_round) == [1, 2, 3]
    assert max(by_round[1]) < min(by_round[2]) and max(by_round[2]) < min(by_round[3])
