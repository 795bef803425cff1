"""Named queries: a Spark function, its oracle text (or none) and the operators it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(*operators: str, sql: str | None = None):
    """Register the function below under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        OPERATORS[f.__name__] = operators
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
