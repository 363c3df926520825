"""The registered queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison; doubles that round to negative zero become zero."""
    out = F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)
    return out.alias(name or x) if name or isinstance(x, str) else out
