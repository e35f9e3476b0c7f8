"""Bars from CSV files: one scan for a whole folder, columns by name, the pair from each file's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import pair_from_file
from tidemark.operators.ranking import keep_last
from tidemark.sources.delimited import name_of, read_by_name, value_of

# Column names of bar files, and endings of their names, the first that there is counts.
TIME_NAMES = ("timestamp", "time_utc", "time", "datetime", "date")
VOLUME_NAMES = ("volume", "tick_volume")
ENDINGS = ("60.csv", "_H1.csv", ".csv")


def _bars(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_by_name(spark, folder)
    name = name_of(F.col("file"))
    rank = F.coalesce(*[F.when(name.endswith(e), F.lit(k)) for k, e in enumerate(ENDINGS)])
    stem = F.regexp_replace(name, r"_H1\.csv$", ".csv")
    price = lambda c: value_of((c,)).try_cast("double")
    rows = raw.select(
        pair_from_file(stem).alias("pair"), F.try_to_timestamp(value_of(TIME_NAMES)).cast("timestamp_ntz").alias("ts"),
        *[price(c).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(value_of(VOLUME_NAMES).try_cast("double"), F.lit(0.0)).alias("volume"),
        rank.alias("rank"), F.struct("file", "part", "place").alias("place"),
    )
    return prioritised(rows.filter("pair is not null"), "rank").dropna(subset=["ts", "open", "high", "low", "close"])


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of a folder: bad stamps and numbers are NULL, incomplete rows go, of equal stamps the last row stays."""
    return keep_last(_bars(spark, folder), ["pair", "ts"], ["place"]).drop("place", "rank")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of a folder, stamps floored to the day; of a day's rows the last stays. A file without volume has 0."""
    return keep_last(_bars(spark, folder).withColumn("ts", F.to_date("ts")), ["pair", "ts"], ["place"]).drop("place", "rank")


def prioritised(candidates: DataFrame, rank: str) -> DataFrame:
    """Of several files of a pair the rows of the one that ranks first."""
    best = candidates.groupBy("pair").agg(F.min(rank).alias(rank))
    return candidates.join(best, ["pair", rank], "left_semi")


def debug_series(spark: SparkSession, folder: str) -> DataFrame:
    """Series of single folds, with pair and fold from names such as `debug_AF_fold3.csv`: `pair, fold, row`, a map by column name."""
    name = name_of(F.col("file"))
    raw = read_by_name(spark, folder, r"^debug_[A-Za-z]+_fold\d+\.csv$")
    return raw.select(F.regexp_extract(name, r"debug_([A-Za-z]+)_fold", 1).alias("pair"), F.regexp_extract(name, r"_fold(\d+)", 1).cast("int").alias("fold"), "row")
