"""Named query registry: each entry is a Spark builder plus, where the
operator is SQL-expressible, an equivalent DuckDB query used as an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return deco


def r6(c) -> Column:
    """Round a double output to 6 places (the oracle rounds the same way)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
