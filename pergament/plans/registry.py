"""Registered queries: name, Spark plan and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded_sql(c: str, digits: int) -> str:
    """``numbers.rounded`` in DuckDB."""
    return f"round(({c})::DECIMAL(28, 10), {digits})::DOUBLE"
