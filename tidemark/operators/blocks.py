"""Carries over blocks of time: what a window over a whole key gives, without one task sorting a whole key.

A key's rows lie in blocks of time. Inside a block a window does the work; between blocks only one row a block is looked
at. So a key of any length is many tasks, and the one that goes over its blocks has a row for each of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 365


def in_blocks_of(df: DataFrame, order: str = "ts", days: int = DAYS) -> DataFrame:
    """`df` with `block`, the number of the stretch of `days` days that `order` (a date or timestamp) is in."""
    return df.withColumn("block", F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / (86_400 * days)))


def met(df: DataFrame, other: DataFrame, on: list[str], columns: list[str], how: str = "left") -> DataFrame:
    """`df` with `columns` of the row of `other` that has the same `on`; nulls are the same as nulls."""
    names = {k: f"__on_{i}" for i, k in enumerate(on)}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(other.select(*[F.col(k).alias(n) for k, n in names.items()], *columns), same, how).drop(*names.values())


def _met(df: DataFrame, keys: list[str], summary: DataFrame, columns: list[str]) -> DataFrame:
    return met(df, summary, [*keys, "block"], columns)


def _inside(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys, "block").orderBy(order)


def _blocks_before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def lagged(df: DataFrame, keys: list[str], value: str, name: str, order: str = "ts") -> DataFrame:
    """`name`: the `value` of the row before, null on a key's first; `df` has `block`."""
    w = _inside(keys, order)
    ends = df.groupBy(*keys, "block").agg(F.max_by(value, order).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*keys).orderBy("block")))
    first = F.row_number().over(w) == 1
    return _met(df.withColumn("__lag", F.lag(value).over(w)).withColumn("__first", first), keys, ends, ["__end"]).withColumn(
        name, F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__lag"))).drop("__lag", "__end", "__first")


def last_value(df: DataFrame, keys: list[str], value: str, name: str, order: str = "ts", strict: bool = False) -> DataFrame:
    """`name`: the last `value` that is not null, at the row or before it; with `strict` only before it."""
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    ends = df.groupBy(*keys, "block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    ends = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(_blocks_before(keys)))
    own = df.withColumn("__own", F.last(value, ignorenulls=True).over(w))
    return _met(own, keys, ends, ["__end"]).withColumn(name, F.coalesce("__own", "__end")).drop("__own", "__end")


def running_sums(df: DataFrame, keys: list[str], values: list[str], order: str = "ts") -> DataFrame:
    """Each of `values` becomes its sum up to the row; nulls count as 0."""
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, "block").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    sums = sums.select(*keys, "block", *[F.sum(f"__{v}").over(_blocks_before(keys)).alias(f"__{v}") for v in values])
    own = df.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    zero = F.lit(0)
    return _met(own, keys, sums, [f"__{v}" for v in values]).withColumns({v: F.col(v) + F.coalesce(f"__{v}", zero) for v in values}).drop(*[f"__{v}" for v in values])


def factor_parts(factor: Column, prefix: str = "") -> list[Column]:
    """A factor as sums can carry it: the logarithm of its size, whether it is negative, whether it is zero."""
    return [
        F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0).alias(f"{prefix}log"),
        F.when(factor < 0, 1).otherwise(0).alias(f"{prefix}negative"),
        F.when(factor == 0, 1).otherwise(0).alias(f"{prefix}zero"),
    ]


def product_of(log: Column, negative: Column, zero: Column) -> Column:
    """The product that the summed parts stand for."""
    return F.when(zero > 0, 0.0).otherwise(F.exp(log) * F.when(negative % 2 == 1, -1.0).otherwise(1.0))
