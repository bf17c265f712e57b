"""Registered queries and the independent SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelshelf.sources.bindings import ansi

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str) -> Callable[[Query], Query]:
    """Register a query; ``{view}`` in ``sql`` pulls in a view definition."""

    def register(function: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = ansi(sql, **views)
        return function

    return register
