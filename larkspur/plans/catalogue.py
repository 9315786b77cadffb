"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine_queries, risk_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_queries.QUERIES | risk_queries.QUERIES | engine_queries.QUERIES
ORACLE_SQL: dict[str, str] = text_queries.ORACLE_SQL | risk_queries.ORACLE_SQL | engine_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules scores of all packages."""
    return QUERIES["q07_rules_score"](spark, sf_dir)
