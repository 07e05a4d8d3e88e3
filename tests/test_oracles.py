"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        if math.isinf(v):
            return ("inf", v > 0)
        return ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(tuple(v.asDict().values()))
    return ("s", str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


def test_every_survey_key_is_registered():
    assert len(QUERIES) >= 107
    missing = set(ORACLES) - set(QUERIES)
    assert not missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["row_id", "rank", "language"]
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    con = duck(SF_SMALL)
    df = QUERIES[key](spark, SF_SMALL)
    got = df.collect()
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(dcols, want)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() > 0
