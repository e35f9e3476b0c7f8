"""Data-quality contracts: each gives the rows or counts that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: how many rows lack it. All columns are counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "field", "n_null")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def lag_violations(df: DataFrame, day: str, made: str, least: int = 1) -> DataFrame:
    """Rows whose features were made less than `least` days before."""
    return df.filter(F.datediff(day, made) < least)


def not_monotone(df: DataFrame, keys: list[str], time: str, arrival: str) -> DataFrame:
    """Per key: rows that arrived after a row of a later time."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(arrival))
    return df.withColumn("back", (F.col(time) < before).cast("long")).groupBy(*keys).agg(F.sum("back").alias("n_back")).filter("n_back > 0")


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: rows beyond its bounds, and its least and greatest value."""
    parts = []
    for c, (low, high) in bounds.items():
        parts += [F.count_if(~F.col(c).between(low, high)).alias(f"{c}_n"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_n").alias("n_bad"), F.col(f"{c}_min").alias("low"), F.col(f"{c}_max").alias("high")) for c in bounds])
    return df.agg(*parts).select(F.inline(rows))


def outside_vocabulary(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values that the vocabulary does not have."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n"))


def incompatible_versions(df: DataFrame, column: str, major: int) -> DataFrame:
    """Schema versions of another major number, or none."""
    number = F.split_part(F.col(column), F.lit("."), F.lit(1)).try_cast("int")
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("ok", F.coalesce(number == major, F.lit(False)))


def too_short(df: DataFrame, key: str, least: int) -> DataFrame:
    """Keys with fewer rows than asked for."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") < least)


def missing_on_either_side(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("only_in", F.lit("first")).unionByName(right.join(left, keys, "left_anti").withColumn("only_in", F.lit("second")))


def recommendation_problems(recommendations: DataFrame, evaluations: DataFrame, versions: list[str]) -> DataFrame:
    """`problem, recommendation_id` of recommendations that lack a field, have a rank below 1, an identifier or rank that another of
    the policy has, a version that is not known, or an evaluation that is not there. Rows and keys are looked at in parallel."""
    r = recommendations
    named = lambda df, problem: df.select(F.lit(problem).alias("problem"), "recommendation_id")
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) for c in ("recommendation_id", "evaluation_id", "recommendation_policy")])
    version = F.get_json_object("metadata", "$.schema_version")
    many = lambda keys: r.join(duplicate_keys(r, keys).select(*keys), keys, "left_semi")
    parts = [
        named(r.filter(empty | F.col("rank").isNull()), "empty"), named(r.filter("rank < 1"), "rank"), named(many(["recommendation_id"]), "same_id"), named(many(["recommendation_policy", "rank"]), "same_rank"),
        named(r.filter(~F.coalesce(version.isin(versions), F.lit(False))), "version"), named(r.join(evaluations.select("evaluation_id"), "evaluation_id", "left_anti"), "unknown"),
    ]
    return reduce(DataFrame.unionByName, parts)


def violations(rules: list[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """One table of (section, severity, run_id, message) from many checks."""
    parts = [df.select(F.lit(section).alias("section"), F.lit(severity).alias("severity"), "run_id", message.alias("message")) for section, severity, df, message in rules]
    return reduce(DataFrame.unionByName, parts)
