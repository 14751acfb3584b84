"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` its rows are tested otherwise."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            CHECKS[name] = sql
        return f

    return register


def r6(*names: str) -> list[Column]:
    """Computed doubles rounded to 6 places, as sums differ in the last digits from engine to engine."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
