"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.virtual import Virtual, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, **views: str):
    """Registers a function of a virtual repository under its name, with equivalent SQL over the views."""

    def add(f: Callable[[Virtual], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Virtual(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, **views)
        return f

    return add
