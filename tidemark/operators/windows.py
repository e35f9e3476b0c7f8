"""Windowed analytics over keyed bars: a DataFrame in, the same rows with more columns out.

Every frame is a row frame within a pair in time order. An aggregate over a frame that is not full yet is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def by_time() -> WindowSpec:
    """A pair in time order."""
    return Window.partitionBy("pair").orderBy("ts")


def last_rows(n: int, until: int = 0) -> WindowSpec:
    """The `n` rows that end `until` rows after the current one."""
    return by_time().rowsBetween(until - n + 1, until)


def full(agg: Column, of: Column | str, n: int, until: int = 0, least: int | None = None) -> Column:
    """`agg` over the last `n` rows, NULL where fewer than `least` (all) of them have a value."""
    frame = last_rows(n, until)
    return F.when(F.count(of).over(frame) >= (least or n), agg.over(frame))


def returns(bars: DataFrame) -> DataFrame:
    """Simple, logarithmic and next return of each bar."""
    back = F.lag("close").over(by_time())
    return bars.withColumns(
        {"returns": F.col("close") / back - 1, "log_returns": F.log(F.col("close") / back), "next_return": F.lead("close").over(by_time()) / F.col("close") - 1}
    )


def targets(bars: DataFrame) -> DataFrame:
    """Sign and binary target of the next return; bars without a return on both sides go."""
    up = F.signum("next_return")
    return returns(bars).withColumns({"next_direction": up, "next_direction_binary": (up > 0).cast("int")}).dropna(subset=["returns", "next_return"])


def lags(df: DataFrame, column: str, steps: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """`column` of the bars so many steps back."""
    return df.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(by_time()) for k in steps})


def rolling(df: DataFrame, column: str, sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean, sample deviation and bias-corrected skewness over the last bars."""
    out = {}
    for w in sizes:
        x = F.col(column)
        out[f"{column}_mean_{w}"] = full(F.avg(x), x, w)
        out[f"{column}_std_{w}"] = full(F.stddev_samp(x), x, w)
        # Spark's skewness is that of a population
        out[f"{column}_skew_{w}"] = full(F.skewness(x), x, w) * (w * (w - 1)) ** 0.5 / (w - 2)
    return df.withColumns(out)


def sma(column: str, n: int) -> Column:
    """Mean of the last `n` bars."""
    return full(F.avg(column), column, n)


def lwma(column: str, n: int) -> Column:
    """Linearly weighted mean of the last `n` bars, the newest with weight `n`."""
    weighted = reduce(lambda a, b: a + b, [F.lag(column, n - w).over(by_time()) * w for w in range(1, n + 1)])
    return weighted / (n * (n + 1) / 2)


def bands(df: DataFrame, middle: Column, spread: Column, k: float) -> DataFrame:
    """`mid`, `upper` and `lower` around a middle line."""
    return df.withColumns({"mid": middle, "upper": middle + spread * k, "lower": middle - spread * k})


def bollinger(df: DataFrame, n: int, k: float) -> DataFrame:
    """Mean of the last `n` closes, and bands of `k` population deviations."""
    return bands(df, sma("close", n), full(F.stddev_pop("close"), "close", n), k)


def weighted_bands(df: DataFrame, n: int = 40, over: int = 20, k: float = 1.0) -> DataFrame:
    """Weighted mean of the last `n` closes, and bands of `k` sample deviations of the last `over`."""
    return bands(df, lwma("close", n), full(F.stddev_samp("close"), "close", over), k)


def donchian(df: DataFrame, n: int) -> DataFrame:
    """Highest and lowest close of the `n` bars before."""
    return df.withColumns({"channel_high": full(F.max("close"), "close", n, -1), "channel_low": full(F.min("close"), "close", n, -1)})


def stochastic(n: int) -> Column:
    """Where the close stands between the extremes of the last `n` bars, in percent."""
    low, high = full(F.min("low"), "low", n), full(F.max("high"), "high", n)
    return (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)) * 100


def true_range(bars: DataFrame) -> DataFrame:
    """`tr`, directional moves `up` and `dn`, `gain` and `loss` of the close; 0 where there is no bar before."""
    close, high, low = (F.lag(c).over(by_time()) for c in ("close", "high", "low"))
    before = F.coalesce(close, F.col("close"))
    up, dn, change = F.col("high") - high, low - F.col("low"), F.col("close") - close
    return bars.withColumns(
        {
            "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
            "up": F.when((up > dn) & (up > 0), up).otherwise(0.0), "dn": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
            "gain": F.when(change > 0, change).otherwise(0.0), "loss": F.when(change < 0, -change).otherwise(0.0),
        }
    )


def range_indicators(df: DataFrame, n: int = 14) -> DataFrame:
    """ATR, ATR in percent, directional indicators, ADX and RSI over plain frames of `n` bars.

    The Wilder-smoothed forms are in `smoothing`; these need no ordered fold and cost one window each.
    """
    df = true_range(df)
    total = lambda c: F.sum(c).over(last_rows(n))
    ready = F.count(F.lit(1)).over(last_rows(n)) == n
    percent = lambda a, b: F.when(ready, 100 * a / F.nullif(b, F.lit(0.0)))
    df = df.withColumns(
        {
            "atr": F.when(ready, F.avg("tr").over(last_rows(n))), "plus_di": percent(total("up"), total("tr")), "minus_di": percent(total("dn"), total("tr")),
            "dx": percent(F.abs(total("up") - total("dn")), total("up") + total("dn")), "rsi": percent(total("gain"), total("gain") + total("loss")),
        }
    )
    return df.withColumns({"atr_pct": F.col("atr") / F.col("close") * 100, "adx": full(F.avg("dx"), "dx", n)}).drop("dx", "up", "dn", "gain", "loss")


def high_volatility(column: str = "atr_pct", n: int = 252, least: int = 126) -> Column:
    """Whether the value reaches its rolling median."""
    return F.coalesce(F.col(column) >= full(F.percentile(column, F.lit(0.5)), column, n, least=least), F.lit(False))


def phases_from_frames(df: DataFrame) -> DataFrame:
    """`high_vol`, `trending` and the phase that they make."""
    df = df.withColumns({"high_vol": high_volatility(), "trending": F.coalesce(F.col("adx") > 25, F.lit(False))})
    return df.withColumn("phase", phase("high_vol", "trending"))


def phase(high_vol: str, trending: str) -> Column:
    """One of the four phases; an unknown flag counts as false."""
    return F.concat(F.when(F.col(high_vol), "HV").otherwise("LV"), F.when(F.col(trending), "_Trend").otherwise("_Ranging"))


def forward_fill(column: str) -> Column:
    """The last known value."""
    return F.last(column, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))


def hold(event: Column) -> Column:
    """The position that the last event asks for; flat before the first."""
    return F.coalesce(F.last(event, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def crosses_above(a: Column, b: Column) -> Column:
    """Now above, and not so on the bar before."""
    return (a > b) & (F.lag(a).over(by_time()) <= F.lag(b).over(by_time()))


def crosses_below(a: Column, b: Column) -> Column:
    """Now below, and not so on the bar before."""
    return (a < b) & (F.lag(a).over(by_time()) >= F.lag(b).over(by_time()))


def drawdown(df: DataFrame, equity: str, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """`peak` so far and the fall from it."""
    peak = F.max(equity).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", F.col(equity) / F.col("peak") - 1)


def normalised(column: str) -> Column:
    """The value as a percentage of the first one."""
    return F.col(column) / F.first(column).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) * 100


def gap_days(df: DataFrame) -> DataFrame:
    """Days since the bar before."""
    return df.withColumn("gap_days", F.datediff("ts", F.lag("ts").over(by_time())))


def islands(df: DataFrame, label: str, name: str = "island") -> DataFrame:
    """A running number for each stretch of equal labels."""
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(by_time()))) | (F.row_number().over(by_time()) == 1)
    return df.withColumn(name, F.sum(changed.cast("long")).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def island_lengths(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Per pair: transitions, and mean, median, least and greatest length of stretches of equal labels. `by`: per such column too, which cuts stretches."""
    by = by or []
    runs = islands(df, label).groupBy("pair", "island", *by).agg(F.count("*").alias("n"))
    return runs.groupBy("pair", *by).agg(
        (F.count("*") - 1).alias("transitions"), F.avg("n").alias("mean_length"), F.percentile("n", F.lit(0.5)).alias("median_length"),
        F.min("n").alias("min_length"), F.max("n").alias("max_length"),
    )


def switched(label: str) -> Column:
    """Whether the label is another than on the bar before; never on the first."""
    return F.coalesce(F.col(label) != F.lag(label).over(by_time()), F.lit(False))


def forward_return(column: str, horizon: int) -> Column:
    """Return over the next `horizon` bars."""
    return F.lead(column, horizon).over(by_time()) / F.col(column) - 1


def with_position(df: DataFrame) -> DataFrame:
    """`pos`: the bar's number within its pair, from 0."""
    return df.withColumn("pos", F.row_number().over(by_time()) - 1)


def position_by_month(df: DataFrame) -> DataFrame:
    """`pos` as `with_position` gives it, for long pairs: no task sorts more than a month of one.

    Rows are numbered within their month, and months start where the counts of those before end; `df` is read twice.
    """
    monthly = df.withColumn("__month", F.date_trunc("month", "ts"))
    before = F.sum("n").over(Window.partitionBy("pair").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1))
    starts = monthly.groupBy("pair", "__month").agg(F.count("*").alias("n")).select(F.col("pair").alias("__p"), F.col("__month").alias("__m"), F.coalesce(before, F.lit(0)).alias("__start"))
    same = F.col("pair").eqNullSafe(F.col("__p")) & F.col("__month").eqNullSafe(F.col("__m"))
    number = F.row_number().over(Window.partitionBy("pair", "__month").orderBy("ts")) - 1
    return monthly.withColumn("__number", number).join(starts, same).withColumn("pos", F.col("__start") + F.col("__number")).select(*df.columns, "pos")


def previous_mean(column: str, n: int = 5) -> Column:
    """Mean of up to `n` bars before the current one."""
    return F.avg(column).over(by_time().rowsBetween(-n, -1))


def state_transitions(df: DataFrame, active: str) -> DataFrame:
    """`transition`: first, enter, exit or steady."""
    before = F.lag(active).over(by_time())
    label = F.when(before.isNull(), "first").when(F.col(active) & ~before, "enter").when(~F.col(active) & before, "exit").otherwise("steady")
    return df.withColumn("transition", label)


def last_share_active(df: DataFrame, share: float) -> DataFrame:
    """Marks the last round(n x share) rows of each pair (half to even) as active."""
    n = F.count("*").over(Window.partitionBy("pair"))
    from_end = F.row_number().over(Window.partitionBy("pair").orderBy(F.col("ts").desc()))
    return df.withColumn("active", from_end <= F.bround(n * share, 0))


def around_transitions(df: DataFrame, active: str, n: int) -> DataFrame:
    """Rows within `n` rows of a change of `active`, with the number of the first change that reaches them."""
    moved = state_transitions(df, active).withColumn("change", F.when(F.col("transition").isin("enter", "exit"), 1).otherwise(0))
    numbered = moved.withColumn("number", F.when(F.col("change") == 1, F.sum("change").over(by_time().rowsBetween(Window.unboundedPreceding, 0))))
    return numbered.withColumn("window", F.min("number").over(by_time().rowsBetween(-n, n))).filter("window is not null")


def sign_flips(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """Per key: changes of sign in order; zeros and NULLs are passed over."""
    moves = df.filter(F.col(column) != 0).select(*keys, F.col(order).alias("o"), F.signum(column).alias("s"))
    before = F.lag("s").over(Window.partitionBy(*keys).orderBy("o"))
    return moves.withColumn("flip", (F.col("s") != before).cast("int")).groupBy(*keys).agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"))


def sentiment_events(hourly: DataFrame) -> DataFrame:
    """Strength of each hour's move, streak of strong hours, and returns over the next 12 and 48 hours."""
    s = hourly.withColumn("abs_sentiment", F.least(F.lit(100.0), F.abs(F.col("close") / F.col("open") - 1) * 200))
    s = s.withColumns({"ret_12b": forward_return("close", 12), "ret_48b": forward_return("close", 48), "strong": F.col("abs_sentiment") >= 70})
    s = s.withColumn("g", F.sum((~F.col("strong")).cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy("pair", "g", "strong").orderBy("ts"))
    return s.select("pair", F.col("ts").alias("entry_time"), "abs_sentiment", F.when(F.col("strong"), streak).otherwise(0).alias("streak"), "ret_12b", "ret_48b")


def in_blocks(df: DataFrame, halo: int, block_rows: int, transform) -> DataFrame:
    """Apply a window `transform` (pair, ts) to few but very long pairs: each block of a pair is a key of its own.

    `df` needs `pos`. A block gets the `halo` rows before it as well, so frames that look back no further give the
    same values as over the whole pair; rows of the halo are dropped from the result.
    """
    block = F.floor(F.col("pos") / block_rows)
    last_of_block = F.col("pos") % block_rows >= block_rows - halo
    own = df.withColumn("block", block).withColumn("halo", F.lit(False))
    lent = df.filter(last_of_block).withColumn("block", block + 1).withColumn("halo", F.lit(True))
    keyed = own.unionByName(lent).withColumn("whole", F.col("pair")).withColumn("pair", F.concat_ws("|", "pair", F.col("block").cast("string")))
    return transform(keyed).filter(~F.col("halo")).withColumn("pair", F.col("whole")).drop("whole", "block", "halo")
