"""Week-block bootstraps over pre-aggregated weeks: replicates are rows, draws are seeded hashes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _draws(weeks: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """For each key and replicate as many drawn weeks as the key has, as `slot` numbers; a key's weeks are few."""
    n = weeks.groupBy(*keys).agg(F.countDistinct("week").alias("n_weeks")).filter("n_weeks >= 3")
    reps = n.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = reps.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n_weeks").cast("int"))))
    return draws.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), *keys, "rep", "draw"), F.col("n_weeks")) + 1)


@dataclass(frozen=True)
class Statistic:
    """A statistic by sums that can be merged: what rows of a week add up to, if need be for each of a bounded number of parts (`part`),
    and how a replicate's sums become one value. Sums are merged before anything is finished, so no task holds a week's rows."""

    sums: dict[str, Column]
    finish: Callable[[DataFrame, list[str]], DataFrame]
    there: Column
    part: Column | None = None


def mean_of(value: str) -> Statistic:
    """The mean of a column's values."""
    return ratio_of(F.col(value), F.when(F.col(value).isNotNull(), 1))


def ratio_of(above: Column, below: Column) -> Statistic:
    """The sum of one column over the sum of another, over rows that have both; NULL where the second is 0."""
    return Statistic({"s": above, "c": below}, lambda merged, by: merged.select(*by, F.try_divide("s", "c").alias("m")), above.isNotNull() & below.isNotNull())


def trimmed_mean_of(value: str, trim: float, width: float) -> Statistic:
    """The mean without the lowest and highest share `trim` of the values.

    Values are counted in bins of `width`; a bin that a bound falls into counts in part, with its own mean. So the result is
    exact where a bin's values are equal, and else is off by less than the width. As many parts are kept as there are bins with values.
    """

    def finish(merged: DataFrame, by: list[str]) -> DataFrame:
        upto = Window.partitionBy(*by).orderBy("part")
        c, n = F.sum("c").over(upto), F.sum("c").over(Window.partitionBy(*by))
        counted = merged.withColumns({"upto": c, "low": n * trim, "high": n * (1 - trim)})
        kept = counted.withColumn("kept", F.greatest(F.lit(0.0), F.least("upto", "high") - F.greatest(F.col("upto") - F.col("c"), F.col("low"))))
        return kept.groupBy(*by).agg(F.try_divide(F.sum(F.col("kept") * F.col("s") / F.col("c")), F.sum("kept")).alias("m"))

    return Statistic({"s": F.col(value), "c": F.lit(1)}, finish, F.col(value).isNotNull(), F.floor(F.col(value) / width))


def interval(rows: DataFrame, keys: list[str], statistic: Statistic, week: str, replicates: int = 2000, seed: int = 42, multiplicity: bool = False) -> DataFrame:
    """2.5 and 97.5 percent bounds of each key's statistic; without `multiplicity` a week drawn twice counts once.

    Rows are summed up per week (and part) before anything is drawn, so the work follows weeks and replicates, not rows.
    """
    parts = [] if statistic.part is None else ["part"]
    placed = rows.filter(statistic.there).select(*keys, F.col(week).alias("week"), *([statistic.part.alias("part")] if parts else []), *[c.alias(f"__{n}") for n, c in statistic.sums.items()])
    sums = placed.groupBy(*keys, "week", *parts).agg(*[F.sum(f"__{n}").alias(n) for n in statistic.sums])
    slots = sums.withColumn("slot", F.dense_rank().over(Window.partitionBy(*keys).orderBy("week")).cast("long"))
    drawn = _draws(sums, keys, replicates, seed).select(*keys, "rep", "slot")
    if not multiplicity:
        drawn = drawn.distinct()
    merged = drawn.join(slots, [*keys, "slot"]).groupBy(*keys, "rep", *parts).agg(*[F.sum(n).alias(n) for n in statistic.sums])
    means = statistic.finish(merged, [*keys, "rep"])
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"), F.count("*").alias("replicates"))


def mean_interval(rows: DataFrame, keys: list[str], value: str, week: str, replicates: int = 2000, seed: int = 42, multiplicity: bool = False) -> DataFrame:
    """Bounds of each key's mean."""
    return interval(rows, keys, mean_of(value), week, replicates, seed, multiplicity)


def difference_interval(rows: DataFrame, keys: list[str], member: str, value: str, week: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Bounds of the difference between members' and others' mean of pair means; weeks drawn twice count twice."""
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "pair", member, F.col(week).alias("week")).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    slots = sums.withColumn("slot", F.dense_rank().over(Window.partitionBy(*keys).orderBy("week")).cast("long"))
    drawn = _draws(sums, keys, replicates, seed).select(*keys, "rep", "slot")
    pairs = drawn.join(slots, [*keys, "slot"]).groupBy(*keys, "rep", "pair", member).agg((F.sum("s") / F.sum("c")).alias("m"))
    diff = pairs.groupBy(*keys, "rep").agg((F.avg(F.when(F.col(member), F.col("m"))) - F.avg(F.when(~F.col(member), F.col("m")))).alias("d"))
    return diff.groupBy(*keys).agg(F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"), F.avg("d").alias("mean_diff"))
