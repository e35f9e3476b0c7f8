"""Wilder smoothing as windows: no ordered fold over single rows, so that long keys run in parallel.

y_t = y_(t-1) + (x_t - y_(t-1)) / n, started with the mean of the first n values. Within a block of BLOCK rows the
recursion is a running sum with rescaled terms; a block's end depends on the one before it by one multiplication
and one addition, so only the ends are folded, one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import lookup
from tidemark.operators import windows as W
from tidemark.storage import materialise

BLOCK = 256


def wilder(df: DataFrame, columns: dict[str, str], n: int) -> DataFrame:
    """`df` with each of `columns` (input: output) smoothed; NULL until `n` values came, NULL where there is no value.

    What leads up to the blocks' ends is written once, as both the ends and the rows are made from it: calling this runs a job.
    """
    decay = F.lit(1 - 1 / n)
    upto = W.by_time().rowsBetween(Window.unboundedPreceding, 0)
    kept = df.columns
    for c in columns:
        x = F.col(c)
        df = df.withColumn(f"__k_{c}", F.when(x.isNotNull(), F.count(x).over(upto) - n)).withColumn(f"__s_{c}", F.avg(x).over(upto))  # 0 at the n-th value
    for c in columns:
        k = F.col(f"__k_{c}")
        df = df.withColumns({f"__b_{c}": F.floor(k / BLOCK), f"__j_{c}": k % BLOCK})
        inside = Window.partitionBy("pair", f"__b_{c}").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        term = F.when(k == 0, F.col(f"__s_{c}")).when(k > 0, F.col(c) / n)
        j = F.col(f"__j_{c}")
        df = df.withColumn(f"__l_{c}", F.when(k >= 0, F.sum(term * F.pow(decay, -j)).over(inside) * F.pow(decay, j)))
    start = materialise(df)
    out = start
    for c, target in columns.items():
        block = F.struct(F.col(f"__b_{c}").alias("b"), F.col(f"__l_{c}").alias("end"), (F.col(f"__j_{c}") + 1).alias("len"))
        last = start.filter(F.col(f"__k_{c}") >= 0).groupBy("pair", f"__b_{c}").agg(F.max_by(block, f"__j_{c}").alias("e"))
        ends = last.groupBy("pair").agg(F.sort_array(F.collect_list("e")).alias("ends"))
        carried = ends.select("pair", F.posexplode(_carries(F.col("ends"), 1 - 1 / n)).alias("__b", f"__c_{c}")).select("pair", F.col("__b").cast("long").alias(f"__b_{c}"), f"__c_{c}")
        out = out.join(carried, ["pair", f"__b_{c}"], "left")
        kept = [*kept, (F.col(f"__l_{c}") + F.pow(decay, F.col(f"__j_{c}") + 1) * F.coalesce(f"__c_{c}", F.lit(0.0))).alias(target)]
    return out.select(*kept)


def _carries(ends: Column, decay: float) -> Column:
    """What each block gets from those before it: zero for the first."""

    def add(done: Column, block: Column) -> Column:
        last = F.element_at(done, -1)
        return F.concat(done, F.array(block["end"] + F.pow(F.lit(decay), block["len"]) * last))

    return F.aggregate(ends, F.array(F.lit(0.0)), add)


def wilder_indicators(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI, ATR, ATR in percent, directional indicators and ADX after Wilder."""
    df = W.true_range(bars)
    first = F.row_number().over(W.by_time()) == 1
    # changes need a bar before; the range of the first bar stands by itself
    for c in ("up", "dn", "gain", "loss"):
        df = df.withColumn(c, F.when(~first, F.col(c)))
    df = wilder(df, {"tr": "atr", "up": "s_up", "dn": "s_dn", "gain": "s_gain", "loss": "s_loss"}, n)
    percent = lambda a, b: 100 * a / F.nullif(b, F.lit(0.0))
    df = df.withColumns(
        {
            "rsi": percent(F.col("s_gain"), F.col("s_gain") + F.col("s_loss")), "atr_pct": F.col("atr") / F.col("close") * 100,
            "plus_di": percent(F.col("s_up"), F.col("atr")), "minus_di": percent(F.col("s_dn"), F.col("atr")),
            "dx": percent(F.abs(F.col("s_up") - F.col("s_dn")), F.col("s_up") + F.col("s_dn")),
        }
    )
    return wilder(df, {"dx": "adx"}, n).drop("up", "dn", "gain", "loss", "s_up", "s_dn", "s_gain", "s_loss", "dx")


def daily_regimes(bars: DataFrame) -> DataFrame:
    """Wilder indicators, flags, phase and stop multiple of daily bars."""
    from tidemark.functions.expr import PHASE_STOP_ATR

    d = W.phases_from_frames(wilder_indicators(bars))
    return d.withColumn("stop_atr_mult", lookup(PHASE_STOP_ATR, F.col("phase")))


def hourly_regimes(bars: DataFrame) -> DataFrame:
    """Relative volatility (ATR 10 over ATR 100, 2 while unknown), ADX above 20, mean of 200, and phase."""
    d = wilder(W.true_range(bars), {"tr": "atr10"}, 10)
    d = wilder(d, {"tr": "atr100"}, 100)
    d = d.withColumn("rel_vol", F.coalesce(F.col("atr10") / F.nullif("atr100", F.lit(0.0)), F.lit(2.0))).drop("tr", "up", "dn", "gain", "loss")
    d = wilder_indicators(d.drop("atr")).withColumn("sma200", W.sma("close", 200))
    d = d.withColumns({"high_vol": F.col("rel_vol") >= 1, "trending": F.coalesce(F.col("adx") > 20, F.lit(False))})
    return d.withColumn("phase", W.phase("high_vol", "trending"))


def labelled(regimes: DataFrame, detector: str, version: str, config_hash: str, least: int = 300) -> DataFrame:
    """Regimes of the pairs with enough bars, with the detector's name, version and configuration."""
    n = F.count("*").over(Window.partitionBy("pair"))
    kept = regimes.withColumn("__n", n).filter(F.col("__n") >= least).drop("__n")
    return kept.withColumns({"detector_id": F.lit(detector), "config_version": F.lit(version), "config_hash": F.lit(config_hash)})
