"""The list of queries, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, also: tuple[str, ...] = ()):
    """Registers a function by its name, with the SQL of the same rows; `also` are further names of it."""

    def add(f):
        for name in (f.__name__, *also):
            QUERIES[name] = f
            if sql:
                ORACLES[name] = sql
        return f

    return add
