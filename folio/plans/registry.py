"""All registered queries of the library outside the corpus subpackage, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; sql: what DuckDB runs for the same rows, None where it cannot say them."""

    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from folio.plans import aggregates, corpus, details, feeds, graph, relational, retrieval, scalars, streams, web, windows  # noqa: F401
