"""SURVEY 5(d) properties over every selection query of the catalogue."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from poolpick import fixtures as fx
from tests.conftest import SF_MID, SF_SMALL

Q = E.queries()
BUDGETED = {
    "select_knn_uncertainty": fx.FLAGSHIP_BUDGET, "select_uncertainty": fx.FLAGSHIP_BUDGET,
    "select_average_dist": fx.FLAGSHIP_BUDGET, "select_average_cosine": fx.FLAGSHIP_BUDGET,
    "select_random": fx.FLAGSHIP_BUDGET, "select_gold": fx.FLAGSHIP_BUDGET, "select_egalitarian": 95,
    "select_knn_uncertainty_noprev": 10, "select_allocated": None, "write_selection": fx.FLAGSHIP_BUDGET,
}


@pytest.mark.parametrize("key", sorted(BUDGETED))
@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_selection_is_a_ranked_set_within_budget(spark, key, sf):
    rows = Q[key](spark, sf).select("row_id", "rank").collect()
    ids = [r.row_id for r in rows]
    assert len(ids) == len(set(ids))
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1))
    if BUDGETED[key] is not None:
        assert len(rows) <= BUDGETED[key]


def test_selection_keeps_prev_first(spark):
    prev = {r.row_id for r in fx.prev_df(spark, SF_SMALL).collect()}
    sel = Q["select_uncertainty"](spark, SF_SMALL).orderBy("rank").collect()
    assert {r.row_id for r in sel[:len(prev)]} == prev


@pytest.mark.parametrize("key", ["select_multi_budget", "select_knn_multi_budget"])
def test_each_budget_is_a_valid_selection(spark, key):
    df = Q[key](spark, SF_SMALL)
    for b in fx.BUDGETS:
        part = df.where(F.col("budget") == b).collect()
        assert len(part) <= b
        assert len({r.row_id for r in part}) == len(part)


def test_uncertainty_budgets_are_prefixes(spark):
    df = Q["select_multi_budget"](spark, SF_SMALL)
    sets = {b: {r.row_id for r in df.where(F.col("budget") == b).collect()} for b in fx.BUDGETS}
    for small, big in zip(fx.BUDGETS, fx.BUDGETS[1:]):
        assert sets[small] <= sets[big]
