"""Grouped summaries of bars, trades and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bars_from_ticks(ticks: DataFrame, keys: list[str], price: str, volume: str, order: str) -> DataFrame:
    """Open, high, low, close and volume of each key's ticks; partial aggregation happens before the shuffle."""
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")
    )


def local_day_bars(hourly: DataFrame, offset_hours: int = 1) -> DataFrame:
    """Daily bars on days of a broker whose clock is `offset_hours` ahead of UTC."""
    day = F.to_date(F.col("ts") + F.make_dt_interval(hours=F.lit(offset_hours)))
    return hourly.withColumn("day", day).groupBy("pair", "day").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def daily_prediction_features(cube: DataFrame) -> DataFrame:
    """Per pair and day: mean, deviation (0 for one), last and mean absolute signal, and sign flips; dated one day later."""
    day = cube.select("pair", F.to_date("timestamp").alias("day"), "timestamp", F.col("signal_strength").alias("s"))
    moves = F.when(F.col("s") != 0, F.signum("s"))
    by = Window.partitionBy("pair", "day").orderBy("timestamp")
    # the last sign before this row that was not zero
    before = F.last(moves, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    flips = day.withColumn("flip", F.coalesce((moves != before).cast("int"), F.lit(0)))
    return flips.groupBy("pair", "day").agg(
        F.avg("s").alias("dl_signal_mean_24h"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("dl_signal_std_24h"), F.max_by("s", "timestamp").alias("dl_signal_last"),
        F.avg(F.abs("s")).alias("dl_signal_abs_mean"), F.sum("flip").alias("dl_signal_flip_count"),
    ).withColumn("trading_day", F.date_add("day", 1)).drop("day")


def share(n: Column, over: Window | None = None) -> Column:
    """A count as a percentage of the total."""
    return n / F.sum(n).over(over if over is not None else Window.partitionBy()) * 100


def phase_summary(df: DataFrame) -> DataFrame:
    """Per phase: bars, mean ATR in percent, mean ADX, and share."""
    g = df.groupBy("phase").agg(F.count("*").alias("n"), F.avg("atr_pct").alias("mean_atr_pct"), F.avg("adx").alias("mean_adx"))
    return g.withColumn("pct", share(F.col("n")))


def phase_distribution(df: DataFrame) -> DataFrame:
    """Per pair and phase: bars and share of the pair's."""
    return df.groupBy("pair", "phase").agg(F.count("*").alias("n")).withColumn("pct", share(F.col("n"), Window.partitionBy("pair")))


def phase_matrix(df: DataFrame, phases: list[str]) -> DataFrame:
    """Pairs by phases: bars."""
    return df.groupBy("pair").pivot("phase", phases).count().fillna(0)


def weighted_means(df: DataFrame, keys: list[str], columns: list[str], weight: str) -> DataFrame:
    """Means weighted by `weight`; groups of no weight go."""
    sums = [(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*sums, F.sum(weight).alias("weight")).filter("weight > 0")


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades, win rate, profit factor (0 without a loss), mean result and days held, gross gain and loss."""
    pnl = F.col("pnl_pct")
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"), F.when(loss > 0, gain / loss).otherwise(0.0).alias("profit_factor"),
        F.avg(pnl).alias("avg_pnl"), F.avg(F.datediff("exit_date", "entry_date")).alias("avg_days"), gain.alias("gross_profit"), loss.alias("gross_loss"),
    )


def equity_metrics(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Total return, annual Sharpe ratio (0 if flat) and deepest fall of the equity that `ret` compounds to."""
    by = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = curve.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(by)))
    fallen = grown.withColumn("fall", F.col("equity") / F.greatest(F.max("equity").over(by), F.lit(1.0)) - 1)
    sharpe = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * 252**0.5
    return fallen.groupBy(*keys).agg((F.max_by("equity", "ts") - 1).alias("total_return"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.min("fall").alias("max_drawdown"))


def describe(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, mean, median, sample deviation, and tails of a column."""
    x = F.col(column)
    return df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std"),
        *[F.percentile(x, F.lit(p / 100)).alias(f"p{p:02d}") for p in (1, 5, 95, 99)],
    )


def trimmed_mean(df: DataFrame, keys: list[str], column: str, cut: float = 0.01) -> DataFrame:
    """Mean without the lowest and highest floor(cut x n) values; the plain mean below three values."""
    known = df.filter(F.col(column).isNotNull())
    order = Window.partitionBy(*keys).orderBy(column)
    ranked = known.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    k = F.when(F.col("n") < 3, 0).otherwise(F.floor(F.col("n") * cut))
    return ranked.filter((F.col("r") > k) & (F.col("r") <= F.col("n") - k)).groupBy(*keys).agg(F.avg(column).alias("trimmed_mean"), F.count("*").alias("n_kept"))


def winsor_bounds(df: DataFrame, column: str, low: float = 0.005, high: float = 0.995, keys: list[str] | None = None) -> DataFrame:
    """Lower and upper quantile, one row per key (or one in all): a table small enough to broadcast."""
    return df.groupBy(*(keys or [])).agg(F.percentile(column, F.lit(low)).alias("low"), F.percentile(column, F.lit(high)).alias("high"))


def entropy(df: DataFrame, keys: list[str], column: str, near: float = 0.05) -> DataFrame:
    """Entropy in bits of {positive, near zero, negative}, its share of the most possible, the rest, and the deviation."""
    x = F.col(column)
    kind = F.when(F.abs(x) <= near, "near_zero").when(x > 0, "positive").otherwise("negative")
    parts = df.filter(x.isNotNull()).groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    total = parts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    h = -F.sum(F.col("p") * F.log2("p"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)))
    return total.groupBy(*keys).agg(F.sum("n").alias("n"), h.alias("entropy"), (h / F.log2(F.lit(3.0))).alias("normalised"), (1 - h / F.log2(F.lit(3.0))).alias("concentration"), spread.alias("std"))


def factor_comparison(runs: DataFrame, factors: dict[str, tuple[str, str]], keys: list[str], metric: str) -> DataFrame:
    """`factor`, the keys, means with and without the factor, their difference, whether both cohorts have runs, and what is missing.

    `factors` gives two conditions, off and on. All are aggregated in one pass over the runs.
    """
    parts = []
    for name, (off, on) in factors.items():
        for side, condition in (("off", off), ("on", on)):
            parts += [F.avg(F.when(F.expr(condition), F.col(metric))).alias(f"{name}_{side}"), F.count_if(F.expr(condition)).alias(f"{name}_{side}_n")]
    each = F.array(*[F.struct(F.lit(n).alias("factor"), *[F.col(f"{n}_{s}{x}").alias(f"{s}{y}") for s in ("on", "off") for x, y in (("", "_mean"), ("_n", "_n"))]) for n in factors])
    long = runs.groupBy(*keys).agg(*parts).select(*keys, F.inline(each))
    none_on, none_off = F.col("on_n") == 0, F.col("off_n") == 0
    warning = F.when(none_on & none_off, "both cohorts missing").when(none_on, "no runs with it").when(none_off, "no runs without it")
    return long.withColumns({"delta": F.col("on_mean") - F.col("off_mean"), "valid": ~none_on & ~none_off, "warning": warning})


def uplift_matrix(runs: DataFrame, by: list[str], pair: str, targets: list[str], metric: str) -> DataFrame:
    """Mean of `metric` for each of `by` and pair, the mean over the pairs that are no targets, and the difference; one row a cell."""
    cells = runs.groupBy(*by, pair).agg(F.avg(metric).alias(f"mean_{metric}"))
    control = F.avg(F.when(~F.col(pair).isin(targets), F.col(f"mean_{metric}"))).over(Window.partitionBy(*by))
    return cells.withColumn("control_mean", control).withColumn("uplift", F.col(f"mean_{metric}") - F.col("control_mean"))
