"""Domain tables derived from the driver's tables: once as DataFrames, once as DuckDB SQL for the oracles.

The two are written apart on purpose, so that an oracle does not repeat a mistake of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates, ledger, signals, windows


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced line items as daily ticks: pair, ts (date), price, volume, seq."""
    return _read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("pair"), F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six pairs over about 2,450 days."""
    return aggregates.bars_from_ticks(ticks(spark, sf_dir), ["pair", "ts"], "price", "volume", "seq")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of five pairs over 30 days."""
    ev = _read(spark, sf_dir, "events").select(
        F.col("event_type").alias("pair"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("value").alias("price"),
        F.lit(1.0).alias("volume"), F.col("ts").alias("seq"),
    )
    return aggregates.bars_from_ticks(ev.withColumnRenamed("hour", "ts"), ["pair", "ts"], "price", "volume", "seq")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with returns, range indicators over plain frames, and phases."""
    return windows.phases_from_frames(windows.range_indicators(windows.returns(bars(spark, sf_dir)), 14))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from events: signal in [-1, 1], available five minutes before, some rows made late or out of range."""
    late = F.col("event_id") % 97 == 0
    raw = F.col("value") / 50 - 1
    return _read(spark, sf_dir, "events").select(
        F.col("event_type").alias("pair"), F.col("ts").alias("timestamp"),
        F.when(late, F.expr("ts + INTERVAL 10 MINUTES")).otherwise(F.expr("ts - INTERVAL 5 MINUTES")).alias("prediction_available_timestamp"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.lit(24).cast("long").alias("target_horizon"), F.lit("price_trend").alias("feature_set"),
        F.element_at(F.array(*map(F.lit, ("HVTF", "LVTF", "HVMR", "LVMR", "OTHER"))), (F.col("user_id") % 5 + 1).cast("int")).alias("dl_regime"),
        F.when(F.col("event_id") % 2 == 0, F.lit(" vol_trend ")).otherwise(F.lit("")).alias("surface_id"), F.lit("2.0.1").alias("schema_version"),
        F.when(F.col("event_id") % 211 == 0, raw * 40).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).alias("signal_strength"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("pred_prob_up"), F.col("event_id"),
    )


def clean_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's causal rows within range."""
    return cube(spark, sf_dir).filter("prediction_available_timestamp <= timestamp and abs(signal_strength) <= 1")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the moving-average cross on all pairs, by islands of the executed signal."""
    return ledger.island_trades(ledger.executed(signals.sma_cross(enriched(spark, sf_dir))))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair and half-year: returns, sharpes of two signal sets, and how far predictions overlap."""
    e = enriched(spark, sf_dir)
    half = (F.year("ts") * 2 + F.when(F.month("ts") > 6, 1).otherwise(0) - 1990 * 2).cast("int")
    keyed = signals.sma_cross(e).withColumn("fold", half).withColumn("s_ret", F.col("signal") * F.col("next_return"))
    return keyed.groupBy("pair", "fold").agg(
        F.count("*").alias("n_bars"), F.avg("s_ret").alias("return_dynamic"), F.avg("next_return").alias("return_baseline"),
        F.coalesce(F.avg("s_ret") / F.nullif(F.stddev_samp("s_ret"), F.lit(0.0)), F.lit(0.0)).alias("sharpe_dynamic"),
        F.coalesce(F.avg("next_return") / F.nullif(F.stddev_samp("next_return"), F.lit(0.0)), F.lit(0.0)).alias("sharpe_baseline"),
        F.min("s_ret").alias("maxdd_dynamic"), F.avg((F.col("volume") > 60).cast("double") * 100).alias("overlap_pct"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector's choices per pair and day: selected type, confidence, activity flags."""
    pick = F.element_at(F.array(F.lit("TF"), F.lit("MR"), F.lit("none")), (F.col("volume").cast("long") % 3 + 1).cast("int"))
    return enriched(spark, sf_dir).select(
        "pair", "ts", pick.alias("selected"), F.when(F.col("volume").cast("long") % 7 == 0, None).otherwise((F.col("volume").cast("long") % 50) / 50).alias("confidence"),
        (F.col("volume").cast("long") % 5 < 2).alias("dl_active"), (F.col("volume").cast("long") % 11 == 0).alias("fallback_active"), "phase", "atr_pct", "next_return",
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy evaluations from folds, two strategies a pair."""
    f = folds(spark, sf_dir)
    two = f.select("pair", "fold", "n_bars", F.lit("dynamic").alias("kind"), F.col("return_dynamic").alias("ret"), F.col("sharpe_dynamic").alias("sharpe"), F.col("maxdd_dynamic").alias("drawdown")).unionByName(
        f.select("pair", "fold", "n_bars", F.lit("baseline").alias("kind"), F.col("return_baseline").alias("ret"), F.col("sharpe_baseline").alias("sharpe"), F.lit(None).cast("double").alias("drawdown"))
    )
    return two.groupBy(F.concat_ws("_", "kind", "pair").alias("strategy_id")).agg(
        F.avg("ret").alias("expected_return"), F.avg("sharpe").alias("expected_sharpe"), F.stddev_pop("sharpe").alias("stability"),
        F.avg("drawdown").alias("expected_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n_folds"), F.sum("n_bars").alias("n_trades"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment events from hourly bars: strength, streak of strong hours, forward returns over 12 and 48 bars."""
    return windows.sentiment_events(hourly(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of experiment runs, one per customer bucket: names, factors and metrics."""
    c = _read(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("run_"), F.lpad((F.col("c_custkey") % 48).cast("string"), 3, "0"), F.lit("_"), F.when(F.col("c_custkey") % 2 == 0, "dl").otherwise("baseline")).alias("run_id"),
        F.element_at(F.array(F.lit("gen1"), F.lit("gen2")), (F.col("c_custkey") % 48 % 2 + 1).cast("int")).alias("generation"),
        F.element_at(F.array(*map(F.lit, ("jpy", "eur", "usd"))), (F.col("c_custkey") % 48 % 3 + 1).cast("int")).alias("family"),
        (F.floor(F.col("c_custkey") % 48 / 6) % 2 == 0).alias("aware"), (F.floor(F.col("c_custkey") % 48 / 12) % 2 == 0).alias("sentiment"),
        F.concat(F.lit("P"), F.col("c_nationkey")).alias("pair"), (F.col("c_acctbal") / 1000).alias("sharpe"), (F.col("c_acctbal") / 100).alias("ret"), F.col("c_custkey").alias("row_id"),
    )


#: name -> (tables it needs, SQL)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), "SELECT l_returnflag || l_linestatus AS pair, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice} AS seq FROM lineitem"),
    "bars": (("ticks",), "SELECT pair, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume FROM ticks GROUP BY pair, ts"),
    "hourly": ((), "SELECT event_type AS pair, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events e GROUP BY event_type, date_trunc('hour', e.ts)"),
    "rets": (("bars",), "SELECT *, close / lag(close) OVER w - 1 AS returns, ln(close / lag(close) OVER w) AS log_returns, lead(close) OVER w / close - 1 AS next_return FROM bars WINDOW w AS (PARTITION BY pair ORDER BY ts)"),
    "moves": (("rets",), """SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr,
        CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w ELSE 0.0 END AS up,
        CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w > low THEN lag(low) OVER w - low ELSE 0.0 END AS dn,
        CASE WHEN close > lag(close) OVER w THEN close - lag(close) OVER w ELSE 0.0 END AS gain, CASE WHEN close < lag(close) OVER w THEN lag(close) OVER w - close ELSE 0.0 END AS loss
        FROM rets WINDOW w AS (PARTITION BY pair ORDER BY ts)"""),
    "sums": (("moves",), """SELECT *, count(*) OVER f AS n, avg(tr) OVER f AS m_tr, sum(up) OVER f AS s_up, sum(dn) OVER f AS s_dn, sum(tr) OVER f AS s_tr, sum(gain) OVER f AS s_gain, sum(loss) OVER f AS s_loss
        FROM moves WINDOW f AS (PARTITION BY pair ORDER BY ts ROWS 13 PRECEDING)"""),
    "ind": (("sums",), """SELECT *, avg(dx) OVER f AS m_dx, count(dx) OVER f AS n_dx FROM (SELECT *, CASE WHEN n = 14 THEN m_tr END AS atr, CASE WHEN n = 14 THEN m_tr / close * 100 END AS atr_pct,
        CASE WHEN n = 14 THEN 100 * s_up / nullif(s_tr, 0) END AS plus_di, CASE WHEN n = 14 THEN 100 * s_dn / nullif(s_tr, 0) END AS minus_di,
        CASE WHEN n = 14 THEN 100 * s_gain / nullif(s_gain + s_loss, 0) END AS rsi,
        CASE WHEN n = 14 THEN 100 * abs(s_up - s_dn) / nullif(s_up + s_dn, 0) END AS dx FROM sums) WINDOW f AS (PARTITION BY pair ORDER BY ts ROWS 13 PRECEDING)"""),
    "enriched": (("ind",), """SELECT * EXCLUDE (m_dx, n_dx, med, n_med, n, m_tr, s_up, s_dn, s_tr, s_gain, s_loss, dx, up, dn, gain, loss), CASE WHEN n_dx = 14 THEN m_dx END AS adx,
        coalesce(n_med >= 126 AND atr_pct >= med, false) AS high_vol, coalesce(n_dx = 14 AND m_dx > 25, false) AS trending,
        CASE WHEN coalesce(n_med >= 126 AND atr_pct >= med, false) THEN 'HV' ELSE 'LV' END || '_' || CASE WHEN coalesce(n_dx = 14 AND m_dx > 25, false) THEN 'Trend' ELSE 'Ranging' END AS phase
        FROM (SELECT *, quantile_cont(atr_pct, 0.5) OVER m AS med, count(atr_pct) OVER m AS n_med FROM ind WINDOW m AS (PARTITION BY pair ORDER BY ts ROWS 251 PRECEDING))"""),
    "cube": ((), """SELECT event_type AS pair, ts AS timestamp, CASE WHEN event_id % 97 = 0 THEN ts + INTERVAL 10 MINUTE ELSE ts - INTERVAL 5 MINUTE END AS prediction_available_timestamp,
        'm' || (user_id % 3) AS model, CAST(24 AS BIGINT) AS target_horizon, 'price_trend' AS feature_set, (['HVTF','LVTF','HVMR','LVMR','OTHER'])[user_id % 5 + 1] AS dl_regime,
        CASE WHEN event_id % 2 = 0 THEN ' vol_trend ' ELSE '' END AS surface_id, '2.0.1' AS schema_version,
        CASE WHEN event_id % 211 = 0 THEN (value / 50 - 1) * 40 ELSE greatest(-1.0, least(1.0, value / 50 - 1)) END AS signal_strength, least(1.0, value / 200) AS pred_prob_up, event_id FROM events"""),
    "clean_cube": (("cube",), "SELECT * FROM cube WHERE prediction_available_timestamp <= timestamp AND abs(signal_strength) <= 1"),
    "smac": (("enriched",), """SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS signal FROM (
        SELECT *, CASE WHEN f < s AND lag(f) OVER w >= lag(s) OVER w THEN -1 WHEN f > s AND lag(f) OVER w <= lag(s) OVER w THEN 1 END AS ev FROM (
        SELECT *, CASE WHEN count(*) OVER w9 = 9 THEN avg(close) OVER w9 END AS f, CASE WHEN count(*) OVER w26 = 26 THEN avg(close) OVER w26 END AS s FROM enriched
        WINDOW w9 AS (PARTITION BY pair ORDER BY ts ROWS 8 PRECEDING), w26 AS (PARTITION BY pair ORDER BY ts ROWS 25 PRECEDING)) WINDOW w AS (PARTITION BY pair ORDER BY ts))"""),
    "exec": (("smac",), "SELECT *, coalesce(lag(signal) OVER (PARTITION BY pair ORDER BY ts), 0) AS executed FROM smac"),
    "islands": (("exec",), "SELECT *, sum(ch) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN executed IS DISTINCT FROM lag(executed) OVER (PARTITION BY pair ORDER BY ts) THEN 1 ELSE 0 END AS ch FROM exec)"),
    "spans": (("islands",), "SELECT pair, island, any_value(executed) AS direction, min(ts) AS entry_date, max(ts) AS last_date, count(*) AS bars, arg_min(close, ts) AS entry_price, arg_max(close, ts) AS last_price, arg_min(phase, ts) AS phase FROM islands GROUP BY pair, island"),
    "trades": (("spans",), """SELECT pair, direction, phase, entry_date, exit_date, entry_price, exit_price, direction * (exit_price / entry_price - 1) AS pnl_pct, bars FROM (
        SELECT *, coalesce(lead(entry_date) OVER w, last_date) AS exit_date, coalesce(lead(entry_price) OVER w, last_price) AS exit_price FROM spans WINDOW w AS (PARTITION BY pair ORDER BY island)) WHERE direction <> 0"""),
    "folds": (("smac",), """SELECT pair, CAST(year(ts) * 2 + CASE WHEN month(ts) > 6 THEN 1 ELSE 0 END - 3980 AS INTEGER) AS fold, count(*) AS n_bars, avg(signal * next_return) AS return_dynamic, avg(next_return) AS return_baseline,
        coalesce(avg(signal * next_return) / nullif(stddev_samp(signal * next_return), 0), 0.0) AS sharpe_dynamic, coalesce(avg(next_return) / nullif(stddev_samp(next_return), 0), 0.0) AS sharpe_baseline,
        min(signal * next_return) AS maxdd_dynamic, avg(CASE WHEN volume > 60 THEN 100.0 ELSE 0.0 END) AS overlap_pct FROM smac GROUP BY 1, 2"""),
    "timeline": (("enriched",), """SELECT pair, ts, (['TF','MR','none'])[CAST(volume AS BIGINT) % 3 + 1] AS selected, CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN NULL ELSE (CAST(volume AS BIGINT) % 50) / 50 END AS confidence,
        CAST(volume AS BIGINT) % 5 < 2 AS dl_active, CAST(volume AS BIGINT) % 11 = 0 AS fallback_active, phase, atr_pct, next_return FROM enriched"""),
    "evals": (("folds",), """SELECT kind || '_' || pair AS strategy_id, avg(ret) AS expected_return, avg(sharpe) AS expected_sharpe, stddev_pop(sharpe) AS stability, avg(drawdown) AS expected_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS win_rate, count(*) AS n_folds, CAST(sum(n_bars) AS BIGINT) AS n_trades FROM (
        SELECT pair, n_bars, 'dynamic' AS kind, return_dynamic AS ret, sharpe_dynamic AS sharpe, maxdd_dynamic AS drawdown FROM folds UNION ALL SELECT pair, n_bars, 'baseline', return_baseline, sharpe_baseline, NULL FROM folds) GROUP BY 1"""),
    "sent0": (("hourly",), "SELECT *, least(100.0, abs(close / open - 1) * 200) AS abs_sentiment, lead(close, 12) OVER w / close - 1 AS ret_12b, lead(close, 48) OVER w / close - 1 AS ret_48b FROM hourly WINDOW w AS (PARTITION BY pair ORDER BY ts)"),
    "sentiment": (("sent0",), """SELECT pair, ts AS entry_time, abs_sentiment, CAST(CASE WHEN abs_sentiment >= 70 THEN row_number() OVER (PARTITION BY pair, g, abs_sentiment >= 70 ORDER BY ts) ELSE 0 END AS INTEGER) AS streak, ret_12b, ret_48b FROM (
        SELECT *, sum(CASE WHEN abs_sentiment >= 70 THEN 0 ELSE 1 END) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM sent0)"""),
    "runs": ((), """SELECT 'run_' || lpad(CAST(c_custkey % 48 AS VARCHAR), 3, '0') || '_' || CASE WHEN c_custkey % 2 = 0 THEN 'dl' ELSE 'baseline' END AS run_id,
        (['gen1','gen2'])[c_custkey % 48 % 2 + 1] AS generation, (['jpy','eur','usd'])[c_custkey % 48 % 3 + 1] AS family, (c_custkey % 48 // 6) % 2 = 0 AS aware, (c_custkey % 48 // 12) % 2 = 0 AS sentiment,
        'P' || c_nationkey AS pair, c_acctbal / 1000 AS sharpe, c_acctbal / 100 AS ret, c_custkey AS row_id FROM customer"""),
}
CTE["hrets"] = (("hourly",), CTE["rets"][1].replace("FROM bars", "FROM hourly"))
CTE["hmoves"] = (("hrets",), CTE["moves"][1].replace("FROM rets", "FROM hrets"))


def prelude(names: tuple[str, ...]) -> str:
    """WITH clause for the named tables and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for x in CTE[name][0]:
                visit(x)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" if order else ""
