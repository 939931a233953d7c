"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgrove import schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, bound: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name; sql follows the binding of the logical tables (or stands alone if not bound)."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"WITH {schema.SQL} {sql}" if bound else sql
        return f

    return put
