"""Declarative strategies: bars in, bars with `signal`, `sl_pct` and `tp_pct` out.

On one bar a short entry comes before a long entry, and both before an exit; else the position is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as W


def _signal(df: DataFrame, short: Column, long: Column, exit_: Column | None = None, sl: float = 0.0, tp: float = 0.0) -> DataFrame:
    event = F.when(short, -1).when(long, 1)
    if exit_ is not None:
        event = event.when(exit_, 0)
    return df.withColumns({"event": event}).withColumns({"signal": W.hold(F.col("event")), "sl_pct": F.lit(sl), "tp_pct": F.lit(tp)}).drop("event")


def _prepared(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def band_breakout(df: DataFrame) -> DataFrame:
    """Trend 1: the close leaves the band of one deviation around the weighted mean of 40; out when it comes back."""
    d, c = W.weighted_bands(df, 40, 20, 1.0), F.col("close")
    up, low = F.col("upper"), F.col("lower")
    return _signal(d, W.crosses_below(c, low), W.crosses_above(c, up), W.crosses_below(c, up) | W.crosses_above(c, low))


def channel_breakout(df: DataFrame) -> DataFrame:
    """Trend 2: the close passes the channel of the 20 closes before; the opposite side reverses."""
    d, c = W.donchian(df, 20), F.col("close")
    return _signal(d, c < F.col("channel_low"), c > F.col("channel_high"))


def sma_cross(df: DataFrame) -> DataFrame:
    """Trend 3: the means of 9 and 26 closes cross; always reversed, never flat."""
    d = _prepared(df, fast=W.sma("close", 9), slow=W.sma("close", 26))
    return _signal(d, W.crosses_below(F.col("fast"), F.col("slow")), W.crosses_above(F.col("fast"), F.col("slow"))).drop("fast", "slow")


def slope_stochastic(df: DataFrame) -> DataFrame:
    """Trend 4: the weighted mean of 40 rises while %K of 5 is below 20, or falls while above 80; out at the other extreme."""
    d = _prepared(df, mean=W.lwma("close", 40), k=W.stochastic(5))
    rise, k = F.col("mean") - F.lag("mean").over(W.by_time()), F.col("k")
    return _signal(d, (rise < 0) & (k > 80), (rise > 0) & (k < 20), (k > 80) | (k < 20))


def bollinger_breakout(df: DataFrame) -> DataFrame:
    """Trend 5: the close crosses a band of one deviation; out where it crosses the centre."""
    d, c = W.bollinger(df, 20, 1.0), F.col("close")
    centre = W.crosses_below(c, F.col("mid")) | W.crosses_above(c, F.col("mid"))
    return _signal(d, W.crosses_below(c, F.col("lower")), W.crosses_above(c, F.col("upper")), centre)


def band_fade(df: DataFrame) -> DataFrame:
    """Reversion 1: against a close that leaves the weighted band; out at the weighted mean."""
    d, c = W.weighted_bands(df, 40, 20, 1.0), F.col("close")
    back = W.crosses_below(c, F.col("mid")) | W.crosses_above(c, F.col("mid"))
    return _signal(d, W.crosses_above(c, F.col("upper")), W.crosses_below(c, F.col("lower")), back, 0.02, 0.02)


def stochastic_turn(df: DataFrame) -> DataFrame:
    """Reversion 2: %K of 2 turns up below 15 or down above 85; out where it crosses 50."""
    d = _prepared(df, k=W.stochastic(2))
    k, before = F.col("k"), F.lag("k").over(W.by_time())
    half = F.lit(50.0)
    return _signal(d, (k > 85) & (k < before), (k < 15) & (k > before), W.crosses_above(k, half) | W.crosses_below(k, half), 0.02, 0.02)


def _recross(df: DataFrame, low: float, high: float, exits: tuple[float, float] | None, allowed: Column, sl: float, tp: float) -> DataFrame:
    rsi = F.col("rsi")
    short, long = W.crosses_below(rsi, F.lit(high)) & allowed, W.crosses_above(rsi, F.lit(low)) & allowed
    out = None if exits is None else W.crosses_above(rsi, F.lit(exits[0])) | W.crosses_below(rsi, F.lit(exits[1]))
    return _signal(df, short, long, out, sl, tp)


def rsi_recross(df: DataFrame) -> DataFrame:
    """Reversion 3: RSI comes back from beyond 25 or 75."""
    return _recross(df, 25.0, 75.0, None, F.lit(True), 0.01, 0.03)


def rsi_guarded(df: DataFrame) -> DataFrame:
    """Reversion 3b: RSI comes back from 35 or 65, outside volatile trends and with ADX below 35; out at 55 and 45."""
    return _recross(df, 35.0, 65.0, (55.0, 45.0), (F.col("phase") != "HV_Trend") & (F.col("adx") < 35), 0.025, 0.0)


def bollinger_fade(df: DataFrame) -> DataFrame:
    """Reversion 5: the close comes back into bands of two deviations."""
    d, c = W.bollinger(df, 20, 2.0), F.col("close")
    return _signal(d, W.crosses_below(c, F.col("upper")), W.crosses_above(c, F.col("lower")), None, 0.02, 0.02)


def bollinger_fade_quiet(df: DataFrame) -> DataFrame:
    """Reversion 4b: as reversion 5, with ADX below 20."""
    d, c, quiet = W.bollinger(df, 20, 2.0), F.col("close"), F.col("adx") < 20
    return _signal(d, W.crosses_below(c, F.col("upper")) & quiet, W.crosses_above(c, F.col("lower")) & quiet, None, 0.025, 0.0125)


def di_cross(df: DataFrame) -> DataFrame:
    """Legacy trend: the directional indicators cross with ADX above 25; out below 15."""
    p, m, strong = F.col("plus_di"), F.col("minus_di"), F.col("adx") > 25
    return _signal(df, W.crosses_below(p, m) & strong, W.crosses_above(p, m) & strong, F.col("adx") < 15)


def rsi_plain(df: DataFrame) -> DataFrame:
    """Legacy reversion: RSI crosses 30 downwards or 70 upwards; out at 50."""
    rsi, half = F.col("rsi"), F.lit(50.0)
    out = W.crosses_above(rsi, half) | W.crosses_below(rsi, half)
    return _signal(df, W.crosses_above(rsi, F.lit(70.0)), W.crosses_below(rsi, F.lit(30.0)), out)


def phase_router(df: DataFrame, trend: str, reversion: str, sizes: dict[str, float]) -> DataFrame:
    """The trend signal in trending phases, else the reversion signal, scaled by the phase's size."""
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("phase")), F.lit(1.0))
    return df.withColumn("signal", F.when(F.col("trending"), F.col(trend)).otherwise(F.col(reversion)) * size)


#: The strategies by name; each takes and gives a DataFrame, and others may be added.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "TF1": band_breakout, "TF2": channel_breakout, "TF3": sma_cross, "TF4": slope_stochastic, "TF5": bollinger_breakout,
    "MR1": band_fade, "MR2": stochastic_turn, "MR3": rsi_recross, "MR32": rsi_guarded, "MR42": bollinger_fade_quiet, "MR5": bollinger_fade,
}


def all_signals(df: DataFrame, names: list[str]) -> DataFrame:
    """One column per strategy, made in one chain over the same bars: they share one sort by pair and time."""
    kept = df.columns
    for name in names:
        df = STRATEGIES[name](df).select(*kept, F.col("signal").alias(name))
        kept = df.columns
    return df


def long_form(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows `pair, ts, strategy_id, signal` from a column per strategy."""
    return df.unpivot(["pair", "ts", "close", "phase", "next_return"], names, "strategy_id", "signal")
