"""Walk-forward folds, labels that look ahead only inside the training span, and label smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.joins import as_of
from tidemark.operators.windows import by_time, islands, with_position


def walk_forward(bars: DataFrame, train_months: int = 84, test_months: int = 6, step_months: int = 6) -> DataFrame:
    """Folds of each pair: training grows from the first bar, the test span follows it, all snapped to bars.

    Boundaries are months from the pair's first day; a boundary stands for the last bar at or before it, found by an
    as-of pass over bars and boundaries in one sort.
    """
    placed = with_position(bars.select("pair", "ts"))
    span = placed.groupBy("pair").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    steps = F.sequence(F.lit(0), F.floor(F.months_between("last", "first") / step_months).cast("int"))
    marks = span.select("pair", "first", "last", F.explode(steps).alias("fold"))
    ends = marks.select(
        "pair", "fold", "last",
        F.add_months("first", F.lit(train_months) + F.col("fold") * step_months).alias("train_until"),
        F.add_months("first", F.lit(train_months + test_months) + F.col("fold") * step_months).alias("test_until"),
    ).filter("test_until <= last")
    for until, end in (("train_until", "train_end"), ("test_until", "test_end")):
        ends = as_of(ends, placed, "pos", ["pair"], until, "ts").withColumnRenamed("pos", end).drop("pos_time")
    return ends.select("pair", "fold", "train_end", "test_end", (F.col("train_end") + 1).alias("test_start")).filter("test_start <= test_end")


def labels_inside(labelled: DataFrame, folds: DataFrame, horizon: int) -> DataFrame:
    """Training rows of each fold whose label looks no further than the training span (`pos`, `train_end`).

    Training spans grow from the first bar, so a row belongs to all later folds: the result is as large as half of rows times folds.
    """
    return labelled.join(folds, "pair").filter(F.col("pos") <= F.col("train_end") - horizon - 1)


def retrain_schedule(bars: DataFrame, warmup: int, every: int, window: int) -> DataFrame:
    """Positions at which a pair's model is fitted anew, with the training span before each."""
    at = with_position(bars).filter((F.col("pos") >= warmup) & ((F.col("pos") - warmup) % every == 0))
    return at.select("pair", "ts", F.col("pos").alias("fit_at"), F.greatest(F.lit(0), F.col("pos") - window).alias("train_from"), (F.col("pos") - 1).alias("train_to"))


def smooth_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """`smoothed`: the label of the last stretch of at least `k` equal labels; before the first such one the first label.

    A stretch that reaches `k` counts from its beginning, so it is marked whole and carried forward from there.
    """
    numbered = islands(df, label)
    n = F.count("*").over(Window.partitionBy("pair", "island"))
    confirmed = numbered.withColumn("n", n).withColumn("ok", F.when(F.col("n") >= k, F.col(label)))
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    smoothed = F.coalesce(F.last("ok", ignorenulls=True).over(upto), F.first(label).over(upto))
    return confirmed.withColumn("smoothed", smoothed).drop("island", "n", "ok")


def best_strategy(returns: DataFrame, keys: list[str]) -> DataFrame:
    """The strategy of the highest return for each key, of equals the first by name."""
    order = F.struct((-F.col("ret")).alias("worse"), F.col("strategy_id"))
    return returns.filter("ret is not null").groupBy(*keys).agg(F.min_by("strategy_id", order).alias("best"), F.max("ret").alias("ret"))
