"""Joins of keyed time series: by day, as of a date, over ranges, and between cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attach_daily(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars with the prediction features dated to their day (made from the day before); bars without stay.

    The features' key is unique by construction, so rows are not multiplied; `lag_violations` and
    `duplicate_keys` in `quality` check tables from elsewhere.
    """
    return bars.join(daily.withColumnRenamed("trading_day", "ts"), ["pair", "ts"], "left")


def as_of(left: DataFrame, right: DataFrame, value: str, keys: list[str], left_time: str, right_time: str) -> DataFrame:
    """`left` with the `value` and time of the last row of `right` at or before its time.

    Both sides are stacked and sorted by key and time once, and the last value is carried forward: one shuffle,
    no row pairs, whatever the distance between the two.
    """
    stacked = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[right_time].dataType).alias("__vt"), F.struct(*left.columns).alias("__row")).unionByName(
        right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(right_time).alias("__vt")), allowMissingColumns=True
    )
    carried = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumns({"__last": F.last("__v", ignorenulls=True).over(carried), "__at": F.last("__vt", ignorenulls=True).over(carried)})
    return found.filter("__side = 1").select("__row.*", F.col("__last").alias(value), F.col("__at").alias(f"{value}_time"))


def in_spans(rows: DataFrame, spans: DataFrame, key: str, position: str, low: str, high: str) -> DataFrame:
    """Rows with the span of their key that holds their position; a key's spans do not overlap.

    The last span that begins at or before the position is found as of it, in one sort, and kept if it reaches so far.
    """
    whole = spans.withColumn("__span", F.struct(*[c for c in spans.columns if c != key]))
    found = as_of(rows, whole, "__span", [key], position, low).drop("__span_time")
    return found.filter(F.col(position) <= F.col("__span")[high]).select(*rows.columns, "__span.*")


def complete_grid(counts: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """One row for each key and each of the fixed values, with zero where there was none."""
    spine = counts.select(*keys).distinct().withColumn(column, F.explode(F.array(*map(F.lit, values))))
    return spine.join(counts, [*keys, column], "left").fillna(0)


def flagged_members(rows: DataFrame, members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with a flag that says whether their key is in `members`."""
    marked = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cohort_deltas(rows: DataFrame, cohort: str, first: str, second: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per key and metric the means of both cohorts and their difference, NULL if a side is missing."""
    long = rows.unpivot([*keys, cohort], metrics, "metric", "value")
    means = long.groupBy(*keys, "metric").agg(
        F.avg(F.when(F.col(cohort) == first, F.col("value"))).alias("first"), F.avg(F.when(F.col(cohort) == second, F.col("value"))).alias("second")
    )
    return means.withColumn("delta", F.col("second") - F.col("first"))


def on_union_of_dates(curves: DataFrame, name: str, time: str, value: str) -> DataFrame:
    """Each curve on all dates of any curve of its pair, carried forward; before its first date NULL."""
    spine = curves.select("pair", time).distinct().join(curves.select("pair", name).distinct(), "pair")
    filled = Window.partitionBy("pair", name).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(curves, ["pair", name, time], "left").withColumn(value, F.last(value, ignorenulls=True).over(filled))
