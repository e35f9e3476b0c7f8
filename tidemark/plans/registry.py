"""All queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import q_archive, q_expressions, q_stateful, q_tables, q_windows  # noqa: F401  they register their queries
from tidemark.plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items to daily bars, a crossing of averages, its trades, and their metrics per pair."""
    return QUERIES["flagship_trade_metrics"](spark, sf_dir)
