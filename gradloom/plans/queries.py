"""All queries of the exam engine and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradloom.plans import analysis_queries, later_queries, more_queries, relational_queries, report_queries, text_queries
from gradloom.plans.exam import Tables, with_views

_ALL = {**text_queries.QUERIES, **relational_queries.QUERIES, **report_queries.QUERIES, **more_queries.QUERIES, **later_queries.QUERIES, **analysis_queries.QUERIES}


def _bound(make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: make(Tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(make) for name, (make, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _ALL.items() if sql}
