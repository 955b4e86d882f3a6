"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.plans import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, body: str | None = None, needs: str = "", recursive: bool = False):
    """Register a query; with ``body`` also its SQL over the CTEs in ``needs``."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if body is not None:
            ORACLES[key] = oracle.sql(needs, body, recursive)
        return fn

    return add
