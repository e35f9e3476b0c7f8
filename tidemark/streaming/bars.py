"""Streaming twins of the batch operators: bounded state, watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import blocks


def day_bars(ticks: DataFrame, late: str = "2 hours", offset: str = "23 hours") -> DataFrame:
    """Daily bars of broker days one hour ahead of UTC (windows start 23 hours after midnight UTC), once each day is over."""
    w = F.window("ts", "1 day", startTime=offset)
    return ticks.withWatermark("ts", late).groupBy("pair", w).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("volume")
    ).select("pair", F.to_date(F.col("window.end") - F.expr("INTERVAL 1 HOUR")).alias("day"), "open", "high", "low", "close", "volume")


def day_features(cube: DataFrame, late: str = "2 hours") -> DataFrame:
    """Prediction features of each day, for the next one."""
    w = F.window("ts", "1 day")
    return cube.withWatermark("ts", late).groupBy("pair", w).agg(
        F.avg("signal").alias("dl_signal_mean_24h"), F.coalesce(F.stddev_samp("signal"), F.lit(0.0)).alias("dl_signal_std_24h"), F.max_by("signal", "ts").alias("dl_signal_last"), F.avg(F.abs("signal")).alias("dl_signal_abs_mean")
    ).select("pair", F.date_add(F.to_date("window.start"), 1).alias("trading_day"), "dl_signal_mean_24h", "dl_signal_std_24h", "dl_signal_last", "dl_signal_abs_mean")


def split_acausal(batch: DataFrame, good: str, quarantine: str) -> None:
    """A micro-batch to two tables: predictions that came in time, and those that did not."""
    marked = batch.withColumn("late", F.col("available_ts") > F.col("ts")).persist()
    marked.filter("not late").drop("late").write.mode("append").parquet(good)
    marked.filter("late").drop("late").write.mode("append").parquet(quarantine)
    marked.unpersist()


def without_duplicates(rows: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sliding(ticks: DataFrame, size: str = "6 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and deviation over sliding windows."""
    w = F.window("ts", size, slide)
    return ticks.withWatermark("ts", late).groupBy("pair", w).agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.count("*").alias("n")).select("pair", F.col("window.start").alias("start"), "mean", "std", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Stretches of activity that end after a gap."""
    w = F.session_window("ts", gap)
    return ticks.withWatermark("ts", late).groupBy("pair", w).agg(F.count("*").alias("n")).select("pair", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def enriched(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return rows.join(dimension, key, "left")


POSITION = "pair string, ts timestamp, position int, n_seen long"
HELD = "pair string, block long, asked int, n long"
FIRST, LAST = -(2**63), 2**63 - 1


def held_positions(batch: DataFrame, number: int, folder: str) -> None:
    """The position that the last event of each pair asks for, and the pair's rows so far: a micro-batch's rows, to `folder`/rows.

    Rows (pair, ts, seq, event) of a micro-batch go by time, those without one last, and at the same time by `seq`, however they lie
    in files and partitions; no task sorts more than a day of a pair. What each pair holds in the end goes to `folder`/held, where
    the next micro-batch takes it up. Both are named by the micro-batch's number, so one that is run again replaces its own rows.
    """
    at = F.struct(F.col("ts").isNull(), "ts", "seq")
    rows = blocks.in_blocks_of(batch, days=1).select("pair", "ts", F.col("event").cast("int").alias("event"), at.alias("at"), F.coalesce("block", F.lit(LAST)).alias("block")).persist()
    last = F.max_by("event", F.when(F.col("event").isNotNull(), F.col("at"))).alias("asked")
    ends = rows.groupBy("pair", "block").agg(last, F.count("*").alias("n"))
    if number:  # what was held before is a block before all others
        ends = ends.unionByName(batch.sparkSession.read.schema(HELD).parquet(f"{folder}/held/batch={number - 1}"))
    ends = ends.persist()
    before = Window.partitionBy("pair").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("pair", "block", F.last("asked", ignorenulls=True).over(before).alias("carried"), F.sum("n").over(before).alias("seen"))
    inside = Window.partitionBy("pair", "block").orderBy("at")
    own = rows.select("pair", "ts", "block", F.last("event", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("asked"), F.row_number().over(inside).alias("n"))
    position, seen = F.coalesce("asked", "carried", F.lit(0)).alias("position"), (F.col("n") + F.coalesce("seen", F.lit(0))).alias("n_seen")
    blocks.met(own, carried, ["pair", "block"], ["carried", "seen"]).select("pair", "ts", position, seen).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    held = ends.groupBy("pair").agg(F.max_by("asked", F.when(F.col("asked").isNotNull(), F.col("block"))).alias("asked"), F.sum("n").alias("n"))
    held.select("pair", F.lit(FIRST).alias("block"), "asked", "n").write.mode("overwrite").parquet(f"{folder}/held/batch={number}")
    ends.unpersist()
    rows.unpersist()
