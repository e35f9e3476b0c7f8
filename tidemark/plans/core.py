"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.derive import prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: How a column leaves Spark and DuckDB alike: by the letter after its name. The billionth keeps halves from rounding apart.
_SPARK = {
    "f": lambda c: (F.round(F.col(c).cast("double") + 1e-9, 6) + F.lit(0.0)).alias(c),
    "g": lambda c: (F.round(F.col(c).cast("double") + 1e-9, 3) + F.lit(0.0)).alias(c),
    "d": lambda c: F.col(c).cast("string").alias(c),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c),
    "i": lambda c: F.col(c).cast("long").alias(c),
    "s": lambda c: F.col(c).cast("string").alias(c),
    "b": lambda c: F.col(c).cast("boolean").alias(c),
}
_DUCK = {
    "f": "round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0 AS {c}",
    "g": "round(CAST({c} AS DOUBLE) + 1e-9, 3) + 0.0 AS {c}",
    "d": "CAST({c} AS VARCHAR) AS {c}",
    "t": "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}",
    "i": "CAST({c} AS BIGINT) AS {c}",
    "s": "CAST({c} AS VARCHAR) AS {c}",
    "b": "CAST({c} AS BOOLEAN) AS {c}",
}


def query(columns: str, sql: str | None = None, uses: str = "", name: str | None = None):
    """Register a function of (spark, sf_dir) with its output columns (`name:kind`), and DuckDB SQL over `uses`."""
    parts = [c.split(":") for c in columns.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[_SPARK[k](c) for c, k in parts])

        run.__doc__ = f.__doc__
        run.__name__ = key
        QUERIES[key] = run
        if sql:
            picked = ", ".join(_DUCK[k].format(c=c) for c, k in parts)
            ORACLE_SQL[key] = f"{prelude(tuple(uses.split()))}SELECT {picked} FROM ({sql}) AS result"
        return f

    return register
