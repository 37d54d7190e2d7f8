"""All queries but those of the training-data subpackage, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import queries_search, queries_text, queries_web

PARTS = (queries_text, queries_search, queries_web)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
