"""Registered queries of the log-analytics operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import detection, heads, streams, texts  # noqa: F401 - importing registers the queries
from .plans.registry import CHECKS, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
