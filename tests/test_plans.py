"""Plan-shape checks: the physical plans we rely on for scale."""

import __spark_entry__ as E
from poolpick import fixtures as fx
from poolpick.operators import strategies as st
from tests.conftest import SF_SMALL

Q = E.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_random_selection_never_scores(spark):
    p = plan(Q["select_random"](spark, SF_SMALL))
    assert "MapInPandas" not in p and "MapInArrow" not in p and "ArrowEvalPython" not in p


def test_per_language_head_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in plan(Q["subset_per_language"](spark, SF_SMALL))


def test_knn_has_no_cartesian_product(spark):
    p = plan(Q["knn_join"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "MapInArrow" in p and "BroadcastExchange" not in p and "CoGroups" not in p


def test_mean_distances_shuffle_neither_side(spark):
    for name in ("pairwise_l2", "mean_dist_per_target"):
        p = plan(Q[name](spark, SF_SMALL))
        assert "MapInArrow" in p and "Exchange" not in p and "Join" not in p


def test_scans_are_not_repartitioned(spark):
    assert "RoundRobin" not in plan(Q["rows_per_language"](spark, SF_SMALL)) and "RoundRobin" not in plan(Q["log_softmax"](spark, SF_SMALL))


def test_passage_search_has_no_nested_loop(spark):
    p = plan(Q["span_in_window"](spark, SF_SMALL))
    assert "NestedLoop" not in p and "Cartesian" not in p and "Python" not in p and "InPandas" not in p


def test_log_softmax_stays_in_the_jvm(spark):
    p = plan(Q["log_softmax"](spark, SF_SMALL))
    assert "Python" not in p and "Arrow" not in p


def test_dedupe_aggregates_map_side(spark):
    p = plan(Q["dedupe_column"](spark, SF_SMALL))
    assert p.count("HashAggregate") >= 2  # partial + final


def test_language_scan_prunes_partitions(spark):
    p = plan(Q["scan_languages"](spark, SF_SMALL))
    assert "PartitionFilters: [" in p and "IN (de,fr)" in p and "ReadSchema: struct<row_id:bigint,config:string>" in p


def test_selection_limit_is_top_k(spark):
    p = plan(st.select_uncertainty(fx.uncertainty_df(spark, SF_SMALL), st.empty_prev(spark), 50))
    assert "TakeOrderedAndProject" in p


def test_docs_scan_prunes_columns(spark):
    p = plan(Q["rows_per_language"](spark, SF_SMALL))
    assert "ReadSchema: struct<lang:string>" in p


def test_rounds_are_prefixes(spark):
    r = Q["al_rounds_uncertainty"](spark, SF_SMALL).orderBy("rank").collect()
    rounds = [x["round"] for x in r]
    assert rounds == sorted(rounds)
    assert [x["rank"] for x in r] == list(range(1, len(r) + 1))


def test_allocated_windows_are_limited(spark):
    assert "WindowGroupLimit" in plan(Q["select_allocated"](spark, SF_SMALL))


def test_egalitarian_takes_quotas_and_fills(spark):
    """The operator itself: small languages whole, equal quotas, then the fill; the budget is met."""
    from collections import Counter

    rows = [(i, "a") for i in range(50)] + [(100 + i, "b") for i in range(3)] + [(200 + i, "c") for i in range(30)]
    pool = spark.createDataFrame(rows, "row_id long, language string")
    got = st.select_egalitarian(pool, st.empty_prev(spark), 21).orderBy("rank").collect()
    lang = dict(rows)
    n = Counter(lang[r.row_id] for r in got)
    assert [r["rank"] for r in got] == list(range(1, 22)) and len({r.row_id for r in got}) == 21
    assert n["b"] == 3 and n["a"] >= 7 and n["c"] >= 7


def test_large_selections_are_ranked_without_a_single_task(spark, monkeypatch):
    monkeypatch.setattr(st, "TOPN_DIRECT_MAX", 10)
    pool = spark.range(500).select("id").withColumnRenamed("id", "row_id")
    got = st.select_random(pool, st.empty_prev(spark), 900).orderBy("rank").collect()
    assert [(r.row_id, r["rank"]) for r in got] == [(i, i + 1) for i in range(500)]
    p = plan(st.select_random(pool, st.empty_prev(spark), 900))
    assert "row_number() windowspecdefinition(_pid" in p  # rows are numbered inside range partitions
    assert "row_number() windowspecdefinition(row_id" not in p


def test_span_search_is_dealt_by_windows(spark, monkeypatch):
    from poolpick.plans import catalog_analysis as ca

    monkeypatch.setattr(ca, "TASK_WINDOWS", 40)
    searched = []
    best = ca.qa.best_spans
    monkeypatch.setattr(ca.qa, "best_spans", lambda f, *a, **k: searched.append(f) or best(f, *a, **k))
    out = Q["qa_best_span"](spark, SF_SMALL)
    rows = searched[0].count()
    assert rows > 40 * 8  # more than the session's tasks would take
    assert searched[0].rdd.getNumPartitions() >= rows // 40
    assert out.count() == fx.docs_df(spark, SF_SMALL).count()
