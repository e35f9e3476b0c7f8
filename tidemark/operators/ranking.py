"""Rankings with defined ties, and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked_recommendations(evaluations: DataFrame, top_n: int | None = None) -> DataFrame:
    """Evaluations by Sharpe ratio, then return, then name; what is not a finite number comes last.

    With `top_n` the rows are cut by a distributed top-k before they are numbered.
    """
    if top_n is not None and top_n <= 0:
        raise ValueError("top_n must be positive")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    order = [finite("expected_sharpe").desc_nulls_last(), finite("expected_return").desc_nulls_last(), F.col("strategy_id").asc()]
    cut = evaluations.orderBy(*order).limit(top_n) if top_n else evaluations
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_changes(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The `n` greatest and the `n` least values of a column."""
    up = df.orderBy(F.col(column).desc_nulls_last(), tie).limit(n).withColumn("side", F.lit("gain"))
    down = df.orderBy(F.col(column).asc_nulls_last(), tie).limit(n).withColumn("side", F.lit("loss"))
    return up.unionByName(down)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns: an aggregate, so hot keys collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
