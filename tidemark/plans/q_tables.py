"""Queries: joins (J), aggregates (A), rankings (T), set operations (U), folds (S) and quality (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import aggregates as A
from tidemark.operators import folds as S
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.operators import ranking as T
from tidemark.operators import windows as W
from tidemark.plans import derive as D
from tidemark.plans.core import query
from tidemark.storage import materialise

_DAILY = """SELECT pair, day + 1 AS trading_day, avg(s) AS dl_signal_mean_24h, coalesce(stddev_samp(s), 0) AS dl_signal_std_24h, arg_max(s, timestamp) AS dl_signal_last, avg(abs(s)) AS dl_signal_abs_mean,
    sum(CASE WHEN s <> 0 AND b <> sign(s) THEN 1 ELSE 0 END) AS dl_signal_flip_count FROM (SELECT *, last_value(CASE WHEN s <> 0 THEN sign(s) END IGNORE NULLS) OVER (PARTITION BY pair, day ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
    FROM (SELECT pair, CAST(timestamp AS DATE) AS day, timestamp, signal_strength AS s FROM clean_cube)) GROUP BY pair, day"""
_HDAILY = "SELECT pair, CAST(ts + INTERVAL 1 HOUR AS DATE) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM hourly h GROUP BY pair, CAST(h.ts + INTERVAL 1 HOUR AS DATE)"


@query("pair:s trading_day:d dl_signal_mean_24h:f dl_signal_std_24h:f dl_signal_last:f dl_signal_abs_mean:f dl_signal_flip_count:i", _DAILY, "clean_cube")
def a02_daily_features(spark, sf):
    """Prediction features per day, dated to the next."""
    return A.daily_prediction_features(D.clean_cube(spark, sf))


@query("pair:s day:d open:f high:f low:f close:f volume:f", f"SELECT pair, ts AS day, open, high, low, close, volume FROM ({_HDAILY})", "hourly")
def a01_local_day_bars(spark, sf):
    """Daily bars on broker days."""
    return A.local_day_bars(D.hourly(spark, sf))


@query("pair:s ts:d close:f dl_signal_mean_24h:f dl_signal_last:f", f"SELECT b.pair, b.ts, b.close, d.dl_signal_mean_24h, d.dl_signal_last FROM ({_HDAILY}) b LEFT JOIN ({_DAILY}) d ON b.pair = d.pair AND b.ts = d.trading_day", "hourly clean_cube")
def j01_attach_daily(spark, sf):
    """Bars with the features of the day before."""
    bars = A.local_day_bars(D.hourly(spark, sf)).withColumnRenamed("day", "ts")
    return J.attach_daily(bars, A.daily_prediction_features(D.clean_cube(spark, sf)))


@query("pair:s entry_time:t abs_sentiment:f sig:f", "SELECT s.pair, s.entry_time, s.abs_sentiment, c.sig FROM sentiment s LEFT JOIN (SELECT pair, date_trunc('hour', timestamp) AS h, avg(signal_strength) AS sig FROM clean_cube WHERE model = 'm1' GROUP BY 1, 2) c ON s.pair = c.pair AND s.entry_time = c.h", "sentiment clean_cube")
def j02_attach_signals(spark, sf):
    """Events with the model's mean signal of their hour."""
    c = D.clean_cube(spark, sf).filter("model = 'm1'").groupBy("pair", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("entry_time")).agg(F.avg("signal_strength").alias("sig"))
    return D.sentiment(spark, sf).join(c, ["pair", "entry_time"], "left")


_HPHASE = "SELECT pair, ts AS entry_time, CASE WHEN high - low > 50 THEN 'HV_Trend' ELSE 'LV_Ranging' END AS phase FROM hourly"


def _hour_phases(spark, sf):
    return D.hourly(spark, sf).select("pair", F.col("ts").alias("entry_time"), F.when(F.col("high") - F.col("low") > 50, "HV_Trend").otherwise("LV_Ranging").alias("phase"))


@query("pair:s entry_time:t phase:s streak:i", f"SELECT * FROM sentiment LEFT JOIN ({_HPHASE}) USING (pair, entry_time)", "sentiment")
def j03_phase_of_events(spark, sf):
    """Events with the phase of their hour."""
    return D.sentiment(spark, sf).join(_hour_phases(spark, sf), ["pair", "entry_time"], "left")


_COUNTS = "SELECT pair, phase, count(*) AS n FROM enriched WHERE phase <> 'LV_Ranging' OR pair < 'B' GROUP BY 1, 2"
_PH = ["HV_Trend", "LV_Trend", "HV_Ranging", "LV_Ranging"]


@query("pair:s phase:s n:i", f"SELECT p.pair, v.phase, coalesce(n, 0) AS n FROM (SELECT DISTINCT pair FROM ({_COUNTS})) p CROSS JOIN (SELECT unnest({_PH}) AS phase) v LEFT JOIN ({_COUNTS}) c ON p.pair = c.pair AND v.phase = c.phase", "enriched")
def j04_complete_grid(spark, sf):
    """Phases a pair never had, as zeros."""
    e = D.enriched(spark, sf).filter("phase <> 'LV_Ranging' or pair < 'B'").groupBy("pair", "phase").agg(F.count("*").alias("n"))
    return J.complete_grid(e, ["pair"], "phase", _PH)


@query(
    "pair:s phase:s n:i n_active:i n_long:i share_of_active:f preference:f",
    """SELECT *, n_active / nullif(sum(n_active) OVER p, 0) AS share_of_active, n_active / nullif(sum(n_active) OVER p, 0) / (n / sum(n) OVER p) AS preference FROM (
        SELECT pair, phase, count(*) AS n, sum(CASE WHEN dl_active THEN 1 ELSE 0 END) AS n_active, sum(CASE WHEN dl_active AND next_return > 0 THEN 1 ELSE 0 END) AS n_long FROM timeline GROUP BY 1, 2) WINDOW p AS (PARTITION BY pair)""", "timeline",
)
def j05_a10_regime_profile(spark, sf):
    """Exposure and preference per regime: one aggregate, totals by window."""
    p = Window.partitionBy("pair")
    g = D.timeline(spark, sf).groupBy("pair", "phase").agg(F.count("*").alias("n"), F.count_if("dl_active").alias("n_active"), F.count_if(F.col("dl_active") & (F.col("next_return") > 0)).alias("n_long"))
    of_active = F.col("n_active") / F.nullif(F.sum("n_active").over(p), F.lit(0))
    return g.withColumns({"share_of_active": of_active, "preference": of_active / (F.col("n") / F.sum("n").over(p))})


_ELIG = "SELECT t.*, a.pair IS NOT NULL AS eligible FROM trades t LEFT JOIN (SELECT DISTINCT pair, ts FROM timeline WHERE dl_active) a ON t.pair = a.pair AND t.entry_date = a.ts"


def _eligible(spark, sf):
    active = D.timeline(spark, sf).filter("dl_active").select("pair", F.col("ts").alias("entry_date"))
    return J.flagged_members(D.trades(spark, sf), active, ["pair", "entry_date"], "eligible")


@query("pair:s entry_date:d direction:i pnl_pct:f eligible:b", _ELIG, "trades timeline")
def j06_trade_eligibility(spark, sf):
    """Trades entered on an active bar."""
    return _eligible(spark, sf)


@query("pair:s n:i", "SELECT pair, count(*) AS n FROM hourly WHERE pair IN (SELECT pair FROM cube WHERE model = 'm2' AND dl_regime = 'HVTF') GROUP BY pair", "hourly cube")
def j07_covered_pairs(spark, sf):
    """Bars of pairs that the cube covers."""
    return D.hourly(spark, sf).join(D.cube(spark, sf).filter("model = 'm2' and dl_regime = 'HVTF'"), "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("n"))


@query("generation:s mean_sharpe:f n_pairs:i n_rows:i", "SELECT generation, avg(sharpe) AS mean_sharpe, count(DISTINCT pair) AS n_pairs, count(*) AS n_rows FROM runs GROUP BY 1", "runs")
def j08_a15_means_with_coverage(spark, sf):
    """Means and coverage in one pass."""
    return D.runs(spark, sf).groupBy("generation").agg(F.avg("sharpe").alias("mean_sharpe"), F.countDistinct("pair").alias("n_pairs"), F.count("*").alias("n_rows"))


@query("pair:s base:f dynamic:f delta:f", "SELECT a.pair, a.s AS base, b.s AS dynamic, b.s - a.s AS delta FROM (SELECT pair, avg(sharpe) AS s FROM runs WHERE generation = 'gen1' GROUP BY 1) a JOIN (SELECT pair, avg(sharpe) AS s FROM runs WHERE generation = 'gen2' GROUP BY 1) b USING (pair)", "runs")
def j09_baseline_delta(spark, sf):
    """Baseline against dynamic per pair."""
    d = J.cohort_deltas(D.runs(spark, sf), "generation", "gen1", "gen2", ["pair"], ["sharpe"]).dropna()
    return d.select("pair", F.col("first").alias("base"), F.col("second").alias("dynamic"), "delta")


@query(
    "pair:s metric:s first:f second:f delta:f",
    """SELECT pair, metric, first, second, second - first AS delta FROM (SELECT pair, 'sharpe' AS metric, avg(CASE WHEN family = 'jpy' THEN sharpe END) AS first, avg(CASE WHEN family = 'eur' THEN sharpe END) AS second FROM runs GROUP BY 1
        UNION ALL SELECT pair, 'ret', avg(CASE WHEN family = 'jpy' THEN ret END), avg(CASE WHEN family = 'eur' THEN ret END) FROM runs GROUP BY 1)""", "runs",
)
def j10_cohort_deltas(spark, sf):
    """Family differences per pair and metric."""
    return J.cohort_deltas(D.runs(spark, sf), "family", "jpy", "eur", ["pair"], ["sharpe", "ret"])


@query("run_id:s only_in:s", "SELECT DISTINCT run_id, 'first' AS only_in FROM runs WHERE family = 'jpy' AND run_id NOT IN (SELECT run_id FROM runs WHERE generation = 'gen1') UNION ALL SELECT DISTINCT run_id, 'second' FROM runs WHERE generation = 'gen1' AND run_id NOT IN (SELECT run_id FROM runs WHERE family = 'jpy')", "runs")
def j11_unmatched(spark, sf):
    """Experiments of one set only."""
    r = D.runs(spark, sf)
    return Q.missing_on_either_side(r.filter("family = 'jpy'"), r.filter("generation = 'gen1'"), ["run_id"])


@query(
    "family:s target_uplift:f control_uplift:f separation:f",
    """SELECT family, avg(u) FILTER (t) AS target_uplift, avg(u) FILTER (NOT t) AS control_uplift, avg(u) FILTER (t) - avg(u) FILTER (NOT t) AS separation FROM (
        SELECT r.family, r.sharpe - b.s AS u, r.pair IN ('P1', 'P2', 'P3') AS t FROM runs r JOIN (SELECT pair, avg(sharpe) AS s FROM runs WHERE generation = 'gen1' GROUP BY 1) b USING (pair) WHERE generation = 'gen2') GROUP BY family""", "runs",
)
def j12_a39_uplift(spark, sf):
    """Uplift over the baseline, targets against controls."""
    r = D.runs(spark, sf)
    base = r.filter("generation = 'gen1'").groupBy("pair").agg(F.avg("sharpe").alias("s"))
    u = r.filter("generation = 'gen2'").join(base, "pair").withColumn("u", F.col("sharpe") - F.col("s")).withColumn("t", F.col("pair").isin("P1", "P2", "P3"))
    t, c = F.avg(F.when(F.col("t"), F.col("u"))), F.avg(F.when(~F.col("t"), F.col("u")))
    return u.groupBy("family").agg(t.alias("target_uplift"), c.alias("control_uplift"), (t - c).alias("separation"))


@query(
    "pair:s day:d close:f close_time:d",
    "SELECT q.pair, q.day, b.close, b.ts AS close_time FROM (SELECT DISTINCT pair, date_trunc('month', ts)::DATE AS day FROM bars) q ASOF LEFT JOIN bars b ON q.pair = b.pair AND q.day >= b.ts", "bars",
)
def j13_as_of(spark, sf):
    """Last bar at or before each month's first day."""
    b = D.bars(spark, sf)
    days = b.select("pair", F.trunc("ts", "month").alias("day")).distinct()
    return J.as_of(days, b, "close", ["pair"], "day", "ts")


_POS = "SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS pos FROM enriched"
_FOLDS = f"""SELECT *, train_end + 1 AS test_start FROM (SELECT p.pair, fold, max(CASE WHEN ts <= train_until THEN pos END) AS train_end, max(CASE WHEN ts <= test_until THEN pos END) AS test_end FROM ({_POS}) p JOIN (
    SELECT pair, fold, last, CAST(first + to_months(CAST(36 + 6 * fold AS INTEGER)) AS DATE) AS train_until, CAST(first + to_months(CAST(42 + 6 * fold AS INTEGER)) AS DATE) AS test_until
    FROM (SELECT pair, min(ts) AS first, max(ts) AS last FROM bars GROUP BY pair), (SELECT unnest(range(0, 40)) AS fold)) f ON p.pair = f.pair WHERE test_until <= last GROUP BY 1, 2) WHERE train_end + 1 <= test_end"""


def _walk(spark, sf):
    return S.walk_forward(D.bars(spark, sf), 36, 6, 6)


@query("pair:s fold:i train_end:i test_start:i test_end:i", _FOLDS, "enriched")
def s05_walk_forward(spark, sf):
    """Expanding training spans and the test spans after them."""
    return _walk(spark, sf)


@query("pair:s fold:i n:i mean_ret:f", f"SELECT pair, fold, count(*) AS n, avg(next_return) AS mean_ret FROM ({_POS}) JOIN ({_FOLDS}) USING (pair) WHERE pos BETWEEN test_start AND test_end GROUP BY 1, 2", "enriched")
def j14_fold_members(spark, sf):
    """Bars of each fold's test span."""
    m = J.in_spans(W.with_position(D.enriched(spark, sf)), _walk(spark, sf), "pair", "pos", "test_start", "test_end")
    return m.groupBy("pair", "fold").agg(F.count("*").alias("n"), F.avg("next_return").alias("mean_ret"))


@query("pair:s fold:i n:i", f"SELECT pair, fold, count(*) AS n FROM ({_POS}) JOIN ({_FOLDS}) USING (pair) WHERE pos <= train_end - 21 GROUP BY 1, 2", "enriched")
def s06_causal_labels(spark, sf):
    """Training rows whose labels stay inside."""
    return S.labels_inside(W.with_position(D.bars(spark, sf)), _walk(spark, sf), 20).groupBy("pair", "fold").agg(F.count("*").alias("n"))


@query("pair:s ts:d fit_at:i train_from:i train_to:i", f"SELECT pair, ts, pos AS fit_at, greatest(0, pos - 504) AS train_from, pos - 1 AS train_to FROM ({_POS}) WHERE pos >= 504 AND (pos - 504) % 63 = 0", "enriched")
def s07_retrain_schedule(spark, sf):
    """When a model is fitted anew."""
    return S.retrain_schedule(D.bars(spark, sf), 504, 63, 504)


@query("year:i n_train:i n_test:i", "SELECT b.y AS year, sum(CASE WHEN a.y < b.y THEN a.n END) AS n_train, any_value(b.n) AS n_test FROM (SELECT year(ts) AS y, count(*) AS n FROM bars GROUP BY 1) a JOIN (SELECT year(ts) AS y, count(*) AS n FROM bars GROUP BY 1) b ON a.y < b.y GROUP BY 1", "bars")
def s08_year_folds(spark, sf):
    """Earlier years to train, each year to test."""
    y = D.bars(spark, sf).groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n_test"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return y.withColumn("n_train", F.sum("n_test").over(before)).filter("n_train is not null")


_SMOOTH = """SELECT *, coalesce(last_value(ok IGNORE NULLS) OVER w, first_value(phase) OVER w) AS smoothed FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY pair, island) >= 3 THEN phase END AS ok FROM (
    SELECT *, sum(c) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY pair ORDER BY ts) THEN 1 ELSE 0 END AS c FROM enriched))) WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)"""


@query("pair:s ts:d phase:s smoothed:s", _SMOOTH, "enriched")
def s02_smooth_labels(spark, sf):
    """Phases that last at least three bars."""
    return S.smooth_labels(D.enriched(spark, sf), "phase", 3)


@query("pair:s relabelled:f", f"SELECT pair, avg(CASE WHEN phase <> smoothed THEN 100.0 ELSE 0 END) AS relabelled FROM ({_SMOOTH}) GROUP BY pair", "enriched")
def a50_relabel_rate(spark, sf):
    """How many bars smoothing changes."""
    s = S.smooth_labels(D.enriched(spark, sf), "phase", 3)
    return s.groupBy("pair").agg((F.avg((F.col("phase") != F.col("smoothed")).cast("double")) * 100).alias("relabelled"))


_CURVES = "SELECT pair, 'c' || (CAST(volume AS BIGINT) % 3) AS strategy_id, ts, close AS equity FROM bars"


@query("pair:s strategy_id:s ts:d equity:f", f"SELECT s.pair, s.strategy_id, s.ts, last_value(c.equity IGNORE NULLS) OVER (PARTITION BY s.pair, s.strategy_id ORDER BY s.ts ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT a.pair, a.ts, b.strategy_id FROM (SELECT DISTINCT pair, ts FROM bars) a JOIN (SELECT DISTINCT pair, strategy_id FROM ({_CURVES})) b USING (pair)) s LEFT JOIN ({_CURVES}) c ON s.pair = c.pair AND s.ts = c.ts AND s.strategy_id = c.strategy_id", "bars")
def j15_union_of_dates(spark, sf):
    """Curves on one calendar."""
    c = D.bars(spark, sf).select("pair", F.concat(F.lit("c"), F.col("volume").cast("long") % 3).alias("strategy_id"), "ts", F.col("close").alias("equity"))
    return J.on_union_of_dates(c, "strategy_id", "ts", "equity")


@query("a_family:s b_family:s sentiment:b aware:b diff:f", "WITH m AS (SELECT family, sentiment, aware, avg(sharpe) AS s FROM runs GROUP BY 1, 2, 3) SELECT a.family AS a_family, b.family AS b_family, a.sentiment, a.aware, b.s - a.s AS diff FROM m a JOIN m b ON a.family < b.family AND a.sentiment = b.sentiment AND a.aware = b.aware".replace("WITH m AS (SELECT family, sentiment, aware, avg(sharpe) AS s FROM runs GROUP BY 1, 2, 3) ", "").replace("FROM m a", "FROM (SELECT family, sentiment, aware, avg(sharpe) AS s FROM runs GROUP BY 1, 2, 3) a").replace("JOIN m b", "JOIN (SELECT family, sentiment, aware, avg(sharpe) AS s FROM runs GROUP BY 1, 2, 3) b"), "runs")
def j16_family_pairs(spark, sf):
    """Families against each other, each pair once; there are as many rows as factor settings."""
    m = D.runs(spark, sf).groupBy("family", "sentiment", "aware").agg(F.avg("sharpe").alias("s"))
    other = m.select(F.col("family").alias("b_family"), "sentiment", "aware", F.col("s").alias("b_s"))
    return m.join(other, ["sentiment", "aware"]).filter("family < b_family").select(F.col("family").alias("a_family"), "b_family", "sentiment", "aware", (F.col("b_s") - F.col("s")).alias("diff"))


@query("pair:s gen1:f gen2:f delta:f", "SELECT *, gen2 - gen1 AS delta FROM (SELECT pair, avg(CASE WHEN generation = 'gen1' THEN ret END) AS gen1, avg(CASE WHEN generation = 'gen2' THEN ret END) AS gen2 FROM runs GROUP BY 1)", "runs")
def j17_generation_coverage(spark, sf):
    """Generations side by side."""
    d = J.cohort_deltas(D.runs(spark, sf), "generation", "gen1", "gen2", ["pair"], ["ret"])
    return d.select("pair", F.col("first").alias("gen1"), F.col("second").alias("gen2"), "delta")


@query("c_custkey:i", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j19_missing_references(spark, sf):
    """Customers that no order refers to."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf}/customer.parquet").join(o, "c_custkey", "left_anti")


@query("variant:s pair:s sharpe:f", "SELECT 'baseline' AS variant, pair, avg(sharpe) AS sharpe FROM runs WHERE NOT aware GROUP BY pair UNION ALL SELECT 'aware', pair, avg(sharpe) FROM runs WHERE aware GROUP BY pair", "runs")
def j20_u01_ablation(spark, sf):
    """Variants stacked."""
    r = D.runs(spark, sf)
    part = lambda c, name: r.filter(c).groupBy("pair").agg(F.avg("sharpe").alias("sharpe")).withColumn("variant", F.lit(name))
    return part("not aware", "baseline").unionByName(part("aware", "aware"))


@query("phase:s n:i mean_atr_pct:f mean_adx:f pct:f", "SELECT phase, count(*) AS n, avg(atr_pct) AS mean_atr_pct, avg(adx) AS mean_adx, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM enriched GROUP BY phase", "enriched")
def a03_phase_summary(spark, sf):
    """Phases summarised."""
    return A.phase_summary(D.enriched(spark, sf))


@query("pair:s phase:s n:i pct:f", "SELECT pair, phase, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY pair) AS pct FROM enriched GROUP BY 1, 2", "enriched")
def a04_phase_distribution(spark, sf):
    """Phases of each pair."""
    return A.phase_distribution(D.enriched(spark, sf))


@query("pair:s HV_Trend:i LV_Trend:i HV_Ranging:i LV_Ranging:i", "SELECT pair, " + ", ".join(f"sum(CASE WHEN phase = '{p}' THEN 1 ELSE 0 END) AS {p}" for p in _PH) + " FROM enriched GROUP BY pair", "enriched")
def a04_phase_matrix(spark, sf):
    """Pairs by phases."""
    return A.phase_matrix(D.enriched(spark, sf), _PH)


@query("phase:s pnl_pct:f bars:f weight:i", "SELECT phase, sum(pnl_pct * bars) / sum(bars) AS pnl_pct, sum(bars * bars) / sum(bars) AS bars, sum(bars) AS weight FROM trades GROUP BY phase", "trades")
def a05_weighted_means(spark, sf):
    """Trade results weighted by length."""
    t = D.trades(spark, sf).withColumn("w", F.col("bars"))
    return A.weighted_means(t, ["phase"], ["pnl_pct", "bars"], "w")


@query("pair:s phase:s n_trades:i win_rate:f avg_pnl:f", "SELECT pair, phase, count(*) AS n_trades, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(pnl_pct) AS avg_pnl FROM trades GROUP BY 1, 2", "trades")
def a07_phase_trades(spark, sf):
    """Trades by entry phase."""
    return A.trade_metrics(D.trades(spark, sf), ["pair", "phase"])


@query("pair:s n:i total:f mean:f median:f std:f win_rate:f", f"SELECT pair, count(*) AS n, sum(pnl_pct) AS total, avg(pnl_pct) AS mean, quantile_cont(pnl_pct, 0.5) AS median, stddev_samp(pnl_pct) AS std, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM ({_ELIG}) WHERE eligible GROUP BY pair", "trades timeline")
def a08_eligible_performance(spark, sf):
    """Trades entered on active bars."""
    x = F.col("pnl_pct")
    return _eligible(spark, sf).filter("eligible").groupBy("pair").agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("win_rate"))


@query("pair:s n_folds:i mean_dynamic:f mean_baseline:f improved:i", "SELECT coalesce(pair, 'all') AS pair, count(*) AS n_folds, avg(sharpe_dynamic) AS mean_dynamic, avg(sharpe_baseline) AS mean_baseline, sum(CASE WHEN sharpe_dynamic > sharpe_baseline THEN 1 ELSE 0 END) AS improved FROM folds GROUP BY ROLLUP(pair)", "folds")
def a09_walk_forward_means(spark, sf):
    """Fold means per pair and in all."""
    r = D.folds(spark, sf).rollup("pair").agg(F.count("*").alias("n_folds"), F.avg("sharpe_dynamic").alias("mean_dynamic"), F.avg("sharpe_baseline").alias("mean_baseline"), F.count_if(F.col("sharpe_dynamic") > F.col("sharpe_baseline")).alias("improved"))
    return r.withColumn("pair", F.coalesce("pair", F.lit("all")))


_SPIKE = "SELECT t.*, atr_pct >= q AS spike, atr_pct >= 0.9 * q AS near FROM timeline t JOIN (SELECT pair, quantile_cont(atr_pct, 0.8) AS q FROM timeline GROUP BY pair) USING (pair)"


@query(
    "pair:s spike_pct:f near_pct:f trend_on_spike:i confident_off:f",
    f"SELECT pair, avg(CASE WHEN spike THEN 100.0 WHEN spike IS NOT NULL THEN 0 END) AS spike_pct, avg(CASE WHEN near THEN 100.0 WHEN near IS NOT NULL THEN 0 END) AS near_pct, sum(CASE WHEN spike AND selected = 'TF' THEN 1 ELSE 0 END) AS trend_on_spike, avg(CASE WHEN NOT spike THEN CASE WHEN confidence >= 0.5 THEN 100.0 ELSE 0 END END) AS confident_off FROM ({_SPIKE}) GROUP BY pair", "timeline",
)
def a11_vol_guard(spark, sf):
    """Volatility guard diagnostics."""
    t = D.timeline(spark, sf)
    q = t.groupBy("pair").agg(F.percentile("atr_pct", F.lit(0.8)).alias("q"))
    m = t.join(q, "pair").withColumns({"spike": F.col("atr_pct") >= F.col("q"), "near": F.col("atr_pct") >= F.col("q") * 0.9})
    sure = F.when(F.col("confidence") >= 0.5, 100.0).otherwise(0.0)
    return m.groupBy("pair").agg((F.avg(F.col("spike").cast("double")) * 100).alias("spike_pct"), (F.avg(F.col("near").cast("double")) * 100).alias("near_pct"), F.count_if(F.col("spike") & (F.col("selected") == "TF")).alias("trend_on_spike"), F.avg(F.when(~F.col("spike"), sure)).alias("confident_off"))


@query("grouping:s value:s n:i mean_sharpe:f", "SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(generation) = 0 THEN 'generation' ELSE 'aware' END AS grouping, coalesce(family, generation, CAST(aware AS VARCHAR)) AS value, count(*) AS n, avg(sharpe) AS mean_sharpe FROM runs GROUP BY GROUPING SETS ((family), (generation), (aware))", "runs")
def a12_grouping_sets(spark, sf):
    """Three single-key groupings in one pass."""
    g = D.runs(spark, sf).groupingSets([["family"], ["generation"], ["aware"]], "family", "generation", "aware").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.grouping_id().alias("g"))
    kind = F.when(F.col("family").isNotNull(), "family").when(F.col("generation").isNotNull(), "generation").otherwise("aware")
    return g.withColumn("grouping", kind).withColumn("value", F.coalesce("family", "generation", F.col("aware").cast("string")))


@query("tau:f n:i mean_ret:f median_dd:f", "SELECT tau, count(*) AS n, avg(return_dynamic) AS mean_ret, quantile_cont(maxdd_dynamic, 0.5) AS median_dd FROM folds, (SELECT unnest([0.0, 25.0, 50.0]) AS tau) WHERE overlap_pct >= tau GROUP BY tau", "folds")
def a13_threshold_sweep(spark, sf):
    """Folds above each of several thresholds."""
    taus = F.explode(F.array(*map(F.lit, (0.0, 25.0, 50.0))))
    s = D.folds(spark, sf).withColumn("tau", taus).filter("overlap_pct >= tau")
    return s.groupBy("tau").agg(F.count("*").alias("n"), F.avg("return_dynamic").alias("mean_ret"), F.percentile("maxdd_dynamic", F.lit(0.5)).alias("median_dd"))


@query("selected:s n:i mean_ret:f", "SELECT selected, count(*) AS n, avg(next_return) AS mean_ret FROM timeline GROUP BY 1", "timeline")
def a14_policy_summary(spark, sf):
    """Results by policy."""
    return D.timeline(spark, sf).groupBy("selected").agg(F.count("*").alias("n"), F.avg("next_return").alias("mean_ret"))


@query("pair:s fold:i threshold:f", f"SELECT pair, fold, quantile_cont(atr_pct, 0.8) AS threshold FROM ({_POS}) JOIN ({_FOLDS}) USING (pair) WHERE pos <= train_end GROUP BY 1, 2", "enriched")
def a16_fold_threshold(spark, sf):
    """Volatility threshold from each fold's training span."""
    m = W.with_position(D.enriched(spark, sf)).join(_walk(spark, sf), "pair").filter("pos <= train_end")
    return m.groupBy("pair", "fold").agg(F.percentile("atr_pct", F.lit(0.8)).alias("threshold"))


@query("horizon:s low:f high:f", "SELECT '12b' AS horizon, quantile_cont(ret_12b, 0.005) AS low, quantile_cont(ret_12b, 0.995) AS high FROM sentiment UNION ALL SELECT '48b', quantile_cont(ret_48b, 0.005), quantile_cont(ret_48b, 0.995) FROM sentiment", "sentiment")
def a17_winsor_bounds(spark, sf):
    """Bounds per horizon."""
    long = D.sentiment(spark, sf).unpivot(["pair"], [F.col("ret_12b").alias("12b"), F.col("ret_48b").alias("48b")], "horizon", "x")
    return A.winsor_bounds(long, "x", keys=["horizon"])


_LONG = f"SELECT pair, phase, '12b' AS horizon, ret_12b AS x, entry_time FROM sentiment LEFT JOIN ({_HPHASE}) USING (pair, entry_time) UNION ALL SELECT pair, phase, '48b', ret_48b, entry_time FROM sentiment LEFT JOIN ({_HPHASE}) USING (pair, entry_time)"


def event_returns(spark, sf):
    """Events with phase, one row per horizon."""
    e = D.sentiment(spark, sf).join(_hour_phases(spark, sf), ["pair", "entry_time"], "left")
    return e.unpivot(["pair", "phase", "entry_time"], [F.col("ret_12b").alias("12b"), F.col("ret_48b").alias("48b")], "horizon", "x")


_DESC = "count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99"


@query("phase:s horizon:s n:i mean:f median:f std:f p01:f p05:f p95:f p99:f", f"SELECT phase, horizon, {_DESC} FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY 1, 2", "sentiment")
def a18_event_summary(spark, sf):
    """Event returns by phase and horizon."""
    return A.describe(event_returns(spark, sf), ["phase", "horizon"], "x")


_TRIM = f"SELECT phase, horizon, avg(x) AS trimmed_mean, count(*) AS n_kept FROM (SELECT *, row_number() OVER (PARTITION BY phase, horizon ORDER BY x) AS r, count(*) OVER (PARTITION BY phase, horizon) AS n FROM ({_LONG}) WHERE x IS NOT NULL) WHERE r > CASE WHEN n < 3 THEN 0 ELSE floor(n * 0.01) END AND r <= n - CASE WHEN n < 3 THEN 0 ELSE floor(n * 0.01) END GROUP BY 1, 2"


@query("phase:s horizon:s trimmed_mean:f n_kept:i", _TRIM, "sentiment")
def a19_trimmed_mean(spark, sf):
    """Means without the tails."""
    return A.trimmed_mean(event_returns(spark, sf), ["phase", "horizon"], "x")


@query("phase:s is_click:b horizon:s n:i mean:f median:f std:f", f"SELECT phase, pair = 'click' AS is_click, horizon, {_DESC} FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY 1, 2, 3", "sentiment")
def a20_stratified(spark, sf):
    """Event returns by phase and kind of pair."""
    return A.describe(event_returns(spark, sf).withColumn("is_click", F.col("pair") == "click"), ["phase", "is_click", "horizon"], "x")


@query("phase:s horizon:s mean_of_means:f median_of_means:f n_pairs:i", f"SELECT phase, horizon, avg(m) AS mean_of_means, quantile_cont(m, 0.5) AS median_of_means, count(*) AS n_pairs FROM (SELECT phase, horizon, pair, avg(x) AS m FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2", "sentiment")
def a21_pair_weighted(spark, sf):
    """Every pair with the same weight."""
    m = event_returns(spark, sf).filter("x is not null").groupBy("phase", "horizon", "pair").agg(F.avg("x").alias("m"))
    return m.groupBy("phase", "horizon").agg(F.avg("m").alias("mean_of_means"), F.percentile("m", F.lit(0.5)).alias("median_of_means"), F.count("*").alias("n_pairs"))


@query("pair:s phase:s horizon:s n:i mean:f median:f std:f", f"SELECT pair, phase, horizon, {_DESC} FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY 1, 2, 3", "sentiment")
def a22_per_pair(spark, sf):
    """Event returns per pair."""
    return A.describe(event_returns(spark, sf), ["pair", "phase", "horizon"], "x")


@query("phase:s horizon:s implausible:b", f"SELECT phase, horizon, abs(trimmed_mean) > 10 * greatest(abs(p05), abs(p95)) AS implausible FROM ({_TRIM}) JOIN (SELECT phase, horizon, {_DESC} FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY 1, 2) USING (phase, horizon)", "sentiment")
def a25_implausible(spark, sf):
    """Trimmed means far beyond the tails."""
    e = event_returns(spark, sf)
    j = A.trimmed_mean(e, ["phase", "horizon"], "x").join(A.describe(e, ["phase", "horizon"], "x"), ["phase", "horizon"])
    return j.withColumn("implausible", F.abs("trimmed_mean") > 10 * F.greatest(F.abs("p05"), F.abs("p95")))


_GAPS = "SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY pair ORDER BY ts), ts) AS g FROM bars"


@query("pair:s n:i over_1d:i over_3d:i max_gap:i ratio:f", f"SELECT pair, count(g) AS n, sum(CASE WHEN g > 1 THEN 1 ELSE 0 END) AS over_1d, sum(CASE WHEN g > 3 THEN 1 ELSE 0 END) AS over_3d, max(g) AS max_gap, sum(CASE WHEN g > 1 THEN 1 ELSE 0 END) / count(g) AS ratio FROM ({_GAPS}) GROUP BY pair", "bars")
def a26_gap_summary(spark, sf):
    """Gaps of each pair."""
    g = F.col("gap_days")
    return W.gap_days(D.bars(spark, sf)).groupBy("pair").agg(F.count(g).alias("n"), F.count_if(g > 1).alias("over_1d"), F.count_if(g > 3).alias("over_3d"), F.max(g).alias("max_gap"), (F.count_if(g > 1) / F.count(g)).alias("ratio"))


@query("pair:s days:i start:d stop:d", "SELECT pair, count(*) AS days, min(ts) AS start, max(ts) AS stop FROM bars GROUP BY pair", "bars")
def a27_coverage(spark, sf):
    """Days of each pair."""
    return D.bars(spark, sf).groupBy("pair").agg(F.count("*").alias("days"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


@query("strategy_id:s expected_return:f expected_sharpe:f stability:f n_folds:i n_trades:i", "SELECT * FROM evals", "evals")
def a28_evaluations(spark, sf):
    """Evaluations per strategy."""
    return D.evaluations(spark, sf)


@query(
    "pair:s n:i entropy:f normalised:f concentration:f std:f",
    """SELECT pair, sum(n) AS n, -sum(p * log2(p)) AS entropy, -sum(p * log2(p)) / log2(3) AS normalised, 1 + sum(p * log2(p)) / log2(3) AS concentration, any_value(sd) AS std FROM (
        SELECT pair, kind, n, n / sum(n) OVER (PARTITION BY pair) AS p, sd FROM (SELECT pair, CASE WHEN abs(d) <= 0.05 THEN 'z' WHEN d > 0 THEN 'p' ELSE 'n' END AS kind, count(*) AS n, any_value(sd) AS sd FROM (SELECT *, sharpe_dynamic - sharpe_baseline AS d, stddev_pop(sharpe_dynamic - sharpe_baseline) OVER (PARTITION BY pair) AS sd FROM folds) GROUP BY 1, 2)) GROUP BY pair""", "folds",
)
def a29_entropy(spark, sf):
    """How evenly fold outcomes are spread."""
    return A.entropy(D.folds(spark, sf).withColumn("d", F.col("sharpe_dynamic") - F.col("sharpe_baseline")), ["pair"], "d")


_SW = "SELECT *, sum(c) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN selected IS DISTINCT FROM lag(selected) OVER (PARTITION BY pair ORDER BY ts) THEN 1 ELSE 0 END AS c FROM timeline)"


@query("pair:s per_1000:f mean_hold:f median_hold:f", f"SELECT pair, (count(*) - 1) * 1000.0 / sum(n) AS per_1000, avg(n) AS mean_hold, quantile_cont(n, 0.5) AS median_hold FROM (SELECT pair, island, count(*) AS n FROM ({_SW}) GROUP BY 1, 2) GROUP BY pair", "timeline")
def a30_switch_density(spark, sf):
    """Switches per thousand rows, and how long choices last."""
    runs = W.islands(D.timeline(spark, sf), "selected").groupBy("pair", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("pair").agg(((F.count("*") - 1) * 1000 / F.sum("n")).alias("per_1000"), F.avg("n").alias("mean_hold"), F.percentile("n", F.lit(0.5)).alias("median_hold"))


_COL = "SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS p, confidence < 0.3 AS low FROM timeline WHERE confidence IS NOT NULL"


@query(
    "pair:s collapses:i mean_recovery:f fallback_entries:i fallback_exits:i entry_rate:f exit_rate:f",
    f"""SELECT pair, collapses, mean_recovery, fallback_entries, fallback_exits, fallback_entries * 1000.0 / n AS entry_rate, fallback_exits * 1000.0 / n AS exit_rate FROM (SELECT pair, count(*) AS collapses, avg(r - p) AS mean_recovery FROM (
        SELECT pair, p, low, lag(low) OVER (PARTITION BY pair ORDER BY p) AS b, min(CASE WHEN NOT low THEN p END) OVER (PARTITION BY pair ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM ({_COL})) WHERE low AND NOT coalesce(b, false) GROUP BY pair) JOIN (
        SELECT pair, count(*) AS n, sum(CASE WHEN fallback_active AND NOT coalesce(f, false) THEN 1 ELSE 0 END) AS fallback_entries, sum(CASE WHEN NOT fallback_active AND coalesce(f, false) THEN 1 ELSE 0 END) AS fallback_exits FROM (SELECT *, lag(fallback_active) OVER (PARTITION BY pair ORDER BY ts) AS f FROM timeline) GROUP BY pair) USING (pair)""", "timeline",
)
def a31_confidence_collapse(spark, sf):
    """Collapses of confidence, and how soon it comes back."""
    t = D.timeline(spark, sf)
    known = t.filter("confidence is not null").withColumn("p", F.row_number().over(W.by_time())).withColumn("low", F.col("confidence") < 0.3)
    by = Window.partitionBy("pair").orderBy("p")
    ahead = F.min(F.when(~F.col("low"), F.col("p"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    begun = known.withColumns({"b": F.coalesce(F.lag("low").over(by), F.lit(False)), "r": ahead}).filter("low and not b")
    c = begun.groupBy("pair").agg(F.count("*").alias("collapses"), F.avg(F.col("r") - F.col("p")).alias("mean_recovery"))
    f = t.withColumn("f", F.coalesce(F.lag("fallback_active").over(W.by_time()), F.lit(False))).groupBy("pair").agg(
        F.count("*").alias("n"), F.count_if(F.col("fallback_active") & ~F.col("f")).alias("fallback_entries"), F.count_if(~F.col("fallback_active") & F.col("f")).alias("fallback_exits"))
    return c.join(f, "pair").withColumns({"entry_rate": F.col("fallback_entries") * 1000 / F.col("n"), "exit_rate": F.col("fallback_exits") * 1000 / F.col("n")})


@query("transition:s mean:f std:f n:i", "SELECT transition, avg(next_return) AS mean, stddev_pop(next_return) AS std, count(next_return) AS n FROM (SELECT *, CASE WHEN lag(dl_active) OVER w IS NULL THEN 'first' WHEN dl_active AND NOT lag(dl_active) OVER w THEN 'enter' WHEN NOT dl_active AND lag(dl_active) OVER w THEN 'exit' ELSE 'steady' END AS transition FROM timeline WINDOW w AS (PARTITION BY pair ORDER BY ts)) GROUP BY 1", "timeline")
def a32_transition_stats(spark, sf):
    """Returns at transitions."""
    s = W.state_transitions(D.timeline(spark, sf), "dl_active")
    return s.groupBy("transition").agg(F.avg("next_return").alias("mean"), F.stddev_pop("next_return").alias("std"), F.count("next_return").alias("n"))


@query("label:s n:i mean_delta:f", "SELECT label, count(*) AS n, avg(sharpe_dynamic - sharpe_baseline) AS mean_delta FROM (SELECT *, unnest(CASE WHEN overlap_pct >= 95 THEN ['full', 'active'] WHEN overlap_pct <= 5 THEN ['full', 'missing'] ELSE ['full', 'partial'] END) AS label FROM folds) GROUP BY label", "folds")
def a33_window_labels(spark, sf):
    """Fold means by the labels a fold has."""
    x = F.col("overlap_pct")
    labels = F.array(F.lit("full"), F.when(x >= 95, "active").when(x <= 5, "missing").otherwise("partial"))
    return D.folds(spark, sf).withColumn("label", F.explode(labels)).groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("sharpe_dynamic") - F.col("sharpe_baseline")).alias("mean_delta"))


@query("pair:s mean_sharpe:f n_runs:i", "SELECT pair, avg(s) AS mean_sharpe, count(*) AS n_runs FROM (SELECT pair, run_id, coalesce(avg(CASE WHEN aware THEN sharpe END), avg(ret)) AS s FROM runs GROUP BY 1, 2) GROUP BY pair", "runs")
def a34_a35_selector_uplift(spark, sf):
    """Mean over runs, from the fallback where the first source is missing."""
    s = D.runs(spark, sf).groupBy("pair", "run_id").agg(F.coalesce(F.avg(F.when(F.col("aware"), F.col("sharpe"))), F.avg("ret")).alias("s"))
    return s.groupBy("pair").agg(F.avg("s").alias("mean_sharpe"), F.count("*").alias("n_runs"))


@query("factor:s value:s run_ids:s", "SELECT factor, value, string_agg(run_id, ',' ORDER BY run_id) AS run_ids FROM (SELECT DISTINCT 'family' AS factor, family AS value, run_id FROM runs UNION SELECT DISTINCT 'generation', generation, run_id FROM runs) GROUP BY 1, 2", "runs")
def a36_factor_crosstab(spark, sf):
    """Runs of each factor value."""
    long = D.runs(spark, sf).unpivot(["run_id"], ["family", "generation"], "factor", "value")
    return long.groupBy("factor", "value").agg(F.array_join(F.sort_array(F.collect_set("run_id")), ",").alias("run_ids"))


#: Factor -> its values off and on.
_FACTORS = {"sentiment": ("sentiment = false", "sentiment = true"), "awareness": ("aware = false", "aware = true"), "training_family": ("family = 'eur'", "family = 'jpy'"), "generation": ("generation = 'gen1'", "generation = 'gen2'")}


@query(
    "factor:s pair:s on_mean:f off_mean:f delta:f valid:b warning:s",
    "SELECT *, on_mean - off_mean AS delta, a > 0 AND b > 0 AS valid, CASE WHEN a = 0 AND b = 0 THEN 'both cohorts missing' WHEN a = 0 THEN 'no runs with it' WHEN b = 0 THEN 'no runs without it' END AS warning FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS factor, pair, avg(sharpe) FILTER ({on}) AS on_mean, avg(sharpe) FILTER ({off}) AS off_mean, count(*) FILTER ({on}) AS a, count(*) FILTER ({off}) AS b FROM runs WHERE row_id % 11 > 0 OR family = 'jpy' GROUP BY pair" for k, (off, on) in _FACTORS.items()) + ")",
    "runs",
)
def a37_binary_factor(spark, sf):
    """Four factors on against off per pair, with validity and what is missing; all factors in one pass."""
    r = D.runs(spark, sf).filter("row_id % 11 > 0 OR family = 'jpy'")
    return A.factor_comparison(r, _FACTORS, ["pair"], "sharpe")


@query("pair:s covered_pct:f", "SELECT pair, avg(CASE WHEN overlap_pct > 5 THEN 100.0 ELSE 0 END) AS covered_pct FROM folds GROUP BY pair", "folds")
def a38_overlap_coverage(spark, sf):
    """Folds that predictions cover."""
    return D.folds(spark, sf).groupBy("pair").agg((F.avg((F.col("overlap_pct") > 5).cast("double")) * 100).alias("covered_pct"))


@query(
    "family:s aware:b pair:s mean_sharpe:f control_mean:f uplift:f",
    """SELECT *, mean_sharpe - control_mean AS uplift FROM (SELECT family, aware, pair, avg(sharpe) AS mean_sharpe FROM runs GROUP BY 1, 2, 3)
       LEFT JOIN (SELECT family, aware, avg(s) AS control_mean FROM (SELECT family, aware, pair, avg(sharpe) AS s FROM runs GROUP BY 1, 2, 3) WHERE pair NOT IN ('P1', 'P2', 'P3') GROUP BY 1, 2) USING (family, aware)""", "runs",
)
def a40_uplift_matrix(spark, sf):
    """Families and feature sets by all pairs, against the mean over the pairs that are no targets."""
    return A.uplift_matrix(D.runs(spark, sf), ["family", "aware"], "pair", ["P1", "P2", "P3"], "sharpe")


@query("improved:i worsened:i mean_abs:f max_abs:f correlation:f verdict:s", "SELECT sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS improved, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS worsened, avg(abs(d)) AS mean_abs, max(abs(d)) AS max_abs, corr(a, b) AS correlation, CASE WHEN avg(abs(d)) < 0.05 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM (SELECT *, b - a AS d FROM (SELECT pair, avg(sharpe) FILTER (generation = 'gen1') AS a, avg(sharpe) FILTER (generation = 'gen2') AS b FROM runs GROUP BY pair))", "runs")
def a41_version_diff(spark, sf):
    """Two versions compared."""
    d = J.cohort_deltas(D.runs(spark, sf), "generation", "gen1", "gen2", ["pair"], ["sharpe"])
    x = F.col("delta")
    return d.agg(F.count_if(x > 0).alias("improved"), F.count_if(x < 0).alias("worsened"), F.avg(F.abs(x)).alias("mean_abs"), F.max(F.abs(x)).alias("max_abs"), F.corr("first", "second").alias("correlation"), F.when(F.avg(F.abs(x)) < 0.05, "PASS").otherwise("REVIEW").alias("verdict"))


_YEARLY = "SELECT CAST(year(ts) AS VARCHAR) AS year, avg(CASE WHEN (signal > 0) = (next_return > 0) THEN 1.0 ELSE 0 END) AS accuracy, avg(signal * next_return) AS mean_ret, avg(CASE WHEN signal * next_return > 0 THEN 1.0 ELSE 0 END) FILTER (signal <> 0) AS hit_rate, avg(signal * next_return) / nullif(stddev_samp(signal * next_return), 0) AS sharpe, count(*) AS n FROM smac WHERE next_return IS NOT NULL GROUP BY 1"


@query("year:s accuracy:f mean_ret:f hit_rate:f sharpe:f n:i", f"{_YEARLY} UNION ALL SELECT 'all', avg(accuracy), avg(mean_ret), avg(hit_rate), avg(sharpe), sum(n) FROM ({_YEARLY})", "smac")
def a42_yearly_metrics(spark, sf):
    """Given predictions, metrics per year, and their means over the years (`all`)."""
    from tidemark.operators.signals import sma_cross

    s = sma_cross(D.enriched(spark, sf)).filter("next_return is not null").withColumn("r", F.col("signal") * F.col("next_return"))
    hit = ((F.col("signal") > 0) == (F.col("next_return") > 0)).cast("double")
    yearly = s.groupBy(F.year("ts").cast("string").alias("year")).agg(
        F.avg(hit).alias("accuracy"), F.avg("r").alias("mean_ret"), F.avg(F.when(F.col("signal") != 0, (F.col("r") > 0).cast("double"))).alias("hit_rate"),
        (F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sharpe"), F.count("*").alias("n"),
    )
    yearly = materialise(yearly)
    return yearly.unionByName(yearly.agg(F.lit("all").alias("year"), *[F.avg(c).alias(c) for c in ("accuracy", "mean_ret", "hit_rate", "sharpe")], F.sum("n").alias("n")))


@query("phase:s model_acc:f persistence_acc:f n:i", "SELECT phase, avg(CASE WHEN m = nx THEN 1.0 ELSE 0 END) AS model_acc, avg(CASE WHEN phase = nx THEN 1.0 ELSE 0 END) AS persistence_acc, count(*) AS n FROM (SELECT phase, lag(phase) OVER w AS m, lead(phase) OVER w AS nx, row_number() OVER w AS r FROM enriched WINDOW w AS (PARTITION BY pair ORDER BY ts)) WHERE r > 504 AND nx IS NOT NULL GROUP BY phase", "enriched")
def a43_prediction_accuracy(spark, sf):
    """A prediction against persistence, after warm-up."""
    e = W.with_position(D.enriched(spark, sf)).withColumns({"m": F.lag("phase").over(W.by_time()), "nx": F.lead("phase").over(W.by_time())}).filter("pos >= 504 and nx is not null")
    return e.groupBy("phase").agg(F.avg((F.col("m") == F.col("nx")).cast("double")).alias("model_acc"), F.avg((F.col("phase") == F.col("nx")).cast("double")).alias("persistence_acc"), F.count("*").alias("n"))


@query("ts:d avg_norm:f", "SELECT ts, avg(norm) AS avg_norm FROM (SELECT ts, close / first_value(close) OVER (PARTITION BY pair ORDER BY ts) * 100 AS norm FROM bars) GROUP BY ts", "bars")
def a44_average_curve(spark, sf):
    """Mean of the normalised curves."""
    return D.bars(spark, sf).withColumn("norm", W.normalised("close")).groupBy("ts").agg(F.avg("norm").alias("avg_norm"))


@query("phase:s up_share:f mean_next:f median_atr:f", "SELECT phase, avg(CASE WHEN next_return > 0 THEN 1.0 WHEN next_return IS NOT NULL THEN 0 END) AS up_share, avg(next_return) AS mean_next, quantile_cont(atr_pct, 0.5) AS median_atr FROM enriched GROUP BY phase", "enriched")
def a45_by_phase(spark, sf):
    """What follows each phase."""
    return D.enriched(spark, sf).groupBy("phase").agg(F.avg((F.col("next_return") > 0).cast("double")).alias("up_share"), F.avg("next_return").alias("mean_next"), F.percentile("atr_pct", F.lit(0.5)).alias("median_atr"))


@query("pair:s spikes:i rate:f", f"SELECT pair, sum(CASE WHEN spike THEN 1 ELSE 0 END) AS spikes, sum(CASE WHEN spike THEN 1 ELSE 0 END) / count(*) AS rate FROM ({_SPIKE}) GROUP BY pair", "timeline")
def a46_spike_rate(spark, sf):
    """How often volatility spikes."""
    t = D.timeline(spark, sf)
    q = t.groupBy("pair").agg(F.percentile("atr_pct", F.lit(0.8)).alias("q"))
    s = F.count_if(F.col("atr_pct") >= F.col("q"))
    return t.join(q, "pair").groupBy("pair").agg(s.alias("spikes"), (s / F.count("*")).alias("rate"))


@query("pair:s rsi_missing:f any_pct:f collapse_pct:f", "SELECT pair, avg(CASE WHEN rsi IS NULL THEN 100.0 ELSE 0 END) AS rsi_missing, avg(CASE WHEN rsi IS NOT NULL OR adx IS NOT NULL THEN 100.0 ELSE 0 END) AS any_pct, avg(CASE WHEN adx IS NULL THEN 100.0 ELSE 0 END) FILTER (rsi IS NOT NULL) AS collapse_pct FROM enriched GROUP BY pair", "enriched")
def a47_missingness(spark, sf):
    """How much is missing, and which share of the usable rows would go if the optional column were required."""
    share = lambda c: F.avg(c.cast("double")) * 100
    rsi, adx = F.col("rsi"), F.col("adx")
    return D.enriched(spark, sf).groupBy("pair").agg(share(rsi.isNull()).alias("rsi_missing"), share(rsi.isNotNull() | adx.isNotNull()).alias("any_pct"), (F.avg(F.when(rsi.isNotNull(), adx.isNull().cast("double"))) * 100).alias("collapse_pct"))


@query("pair:s day:d valid_hours:i phase:s share:f", f"SELECT pair, day, sum(n) AS valid_hours, arg_max(phase, n * 10 + CASE WHEN phase = 'HV_Trend' THEN 1 ELSE 0 END) AS phase, max(n) / sum(n) AS share FROM (SELECT pair, CAST(entry_time AS DATE) AS day, phase, count(*) AS n FROM ({_HPHASE}) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n) >= 12", "hourly")
def a48_daily_regime(spark, sf):
    """A day's regime from its hours: the most frequent, by priority if tied."""
    n = _hour_phases(spark, sf).groupBy("pair", F.to_date("entry_time").alias("day"), "phase").agg(F.count("*").alias("n"))
    prior = F.when(F.col("phase") == "HV_Trend", 1).otherwise(0)
    return n.groupBy("pair", "day").agg(F.sum("n").alias("valid_hours"), F.max_by("phase", F.struct("n", prior)).alias("phase"), (F.max("n") / F.sum("n")).alias("share")).filter("valid_hours >= 12")


@query("pair:s selected:s pct:f", "SELECT pair, selected, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY pair) AS pct FROM timeline GROUP BY 1, 2", "timeline")
def a49_selection_mix(spark, sf):
    """What is selected how often."""
    g = D.timeline(spark, sf).groupBy("pair", "selected").agg(F.count("*").alias("n"))
    return g.withColumn("pct", A.share(F.col("n"), Window.partitionBy("pair")))


@query("strategy_id:s rank:i", "SELECT strategy_id, row_number() OVER (ORDER BY expected_sharpe DESC NULLS LAST, expected_return DESC NULLS LAST, strategy_id) AS rank FROM evals QUALIFY rank <= 5", "evals")
def t01_recommendations(spark, sf):
    """The five best strategies."""
    return T.ranked_recommendations(D.evaluations(spark, sf), 5)


_BEST = "SELECT pair, fold, 'dynamic' AS s, return_dynamic AS r FROM folds UNION ALL SELECT pair, fold, 'baseline', return_baseline FROM folds"


@query("pair:s fold:i best:s ret:f", f"SELECT pair, fold, s AS best, r AS ret FROM ({_BEST}) WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair, fold ORDER BY r DESC, s) = 1", "folds")
def t02_best_strategy(spark, sf):
    """The best of two per fold."""
    long = D.folds(spark, sf).unpivot(["pair", "fold"], [F.col("return_dynamic").alias("dynamic"), F.col("return_baseline").alias("baseline")], "strategy_id", "ret")
    return S.best_strategy(long, ["pair", "fold"])


@query("family:s pair:s sharpe:f", "SELECT family, pair, s AS sharpe FROM (SELECT family, pair, avg(sharpe) AS s FROM runs GROUP BY 1, 2) ORDER BY s DESC, pair LIMIT 1", "runs")
def t03_t06_best_combo(spark, sf):
    """The best combination."""
    return D.runs(spark, sf).groupBy("family", "pair").agg(F.avg("sharpe").alias("sharpe")).orderBy(F.desc("sharpe"), "pair").limit(1)


@query("pair:s delta:f side:s", "SELECT * FROM (SELECT pair, b - a AS delta, 'gain' AS side FROM (SELECT pair, avg(sharpe) FILTER (generation = 'gen1') AS a, avg(sharpe) FILTER (generation = 'gen2') AS b FROM runs GROUP BY 1) ORDER BY b - a DESC NULLS LAST, pair LIMIT 3) UNION ALL SELECT * FROM (SELECT pair, b - a AS delta, 'loss' AS side FROM (SELECT pair, avg(sharpe) FILTER (generation = 'gen1') AS a, avg(sharpe) FILTER (generation = 'gen2') AS b FROM runs GROUP BY 1) ORDER BY b - a NULLS LAST, pair LIMIT 3)", "runs")
def t04_top_changes(spark, sf):
    """Greatest gains and losses."""
    return T.top_changes(J.cohort_deltas(D.runs(spark, sf), "generation", "gen1", "gen2", ["pair"], ["sharpe"]), "delta", 3, "pair")


@query("pair:s ts:d gap_days:i", f"SELECT pair, ts, g AS gap_days FROM ({_GAPS}) WHERE g > 1 ORDER BY g DESC, pair, ts LIMIT 20", "bars")
def t05_largest_gaps(spark, sf):
    """The twenty longest gaps."""
    return W.gap_days(D.bars(spark, sf)).filter("gap_days > 1").orderBy(F.desc("gap_days"), "pair", "ts").limit(20)


@query("run_id:s place:i", "SELECT run_id, row_number() OVER (ORDER BY generation NULLS LAST, family NULLS LAST, run_id) AS place FROM (SELECT DISTINCT run_id, generation, family FROM runs)", "runs")
def t07_run_order(spark, sf):
    """Runs in a defined order; there are as many as experiments."""
    r = D.runs(spark, sf).select("run_id", "generation", "family").distinct()
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.col("generation").asc_nulls_last(), F.col("family").asc_nulls_last(), "run_id")))


@query("o_custkey:i o_orderkey:i o_totalprice:f", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def u02_keep_last(spark, sf):
    """Last order of each customer."""
    return T.keep_last(spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("surface_id:s dl_regime:s model:s", "SELECT DISTINCT surface_id, dl_regime, model FROM cube", "cube")
def u03_src04_available_surfaces(spark, sf):
    """Surfaces that the cube has."""
    return D.cube(spark, sf).select("surface_id", "dl_regime", "model").distinct()


@query("ts:d kind:s", "SELECT ts, 'both' AS kind FROM (SELECT ts FROM bars WHERE pair = 'AF' INTERSECT SELECT ts FROM bars WHERE pair = 'NO') UNION ALL SELECT ts, 'first' FROM (SELECT ts FROM bars WHERE pair = 'AF' EXCEPT SELECT ts FROM bars WHERE pair = 'NO')", "bars")
def u04_u05_day_sets(spark, sf):
    """Days of two pairs: common ones and those of the first only."""
    b = D.bars(spark, sf)
    a, n = b.filter("pair = 'AF'").select("ts"), b.filter("pair = 'NO'").select("ts")
    return a.intersect(n).withColumn("kind", F.lit("both")).unionByName(a.subtract(n).withColumn("kind", F.lit("first")))


@query("pair:s model:s n:i mean_signal:f", "SELECT pair, model, count(*) AS n, avg(signal_strength) AS mean_signal FROM cube WHERE trim(surface_id) = 'vol_trend' AND model = 'm0' AND dl_regime = 'HVTF' GROUP BY 1, 2", "cube")
def src04_one_surface(spark, sf):
    """One surface of the cube."""
    from tidemark.sources.cube import select_surface

    s = select_surface(D.cube(spark, sf), surface_id="vol_trend", model="m0", dl_regime="HVTF")
    return s.groupBy("pair", "model").agg(F.count("*").alias("n"), F.avg("dl_signal").alias("mean_signal"))


@query("pair:s entry_time:t abs_sentiment:f streak:i ret_12b:f ret_48b:f", "SELECT * FROM sentiment", "sentiment")
def src07_sentiment_events(spark, sf):
    """The event table."""
    return D.sentiment(spark, sf)


# quality


@query("field:s n_null:i", 'SELECT * FROM (SELECT \'rsi\' AS field, sum(CASE WHEN rsi IS NULL THEN 1 ELSE 0 END) AS n_null FROM enriched UNION ALL SELECT \'close\', sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) FROM enriched)', "enriched")
def q01_nulls(spark, sf):
    """Missing values of contract columns."""
    return Q.null_counts(D.enriched(spark, sf), ["rsi", "close"])


@query("pair:s hour:t n:i", "SELECT pair, date_trunc('hour', timestamp) AS hour, count(*) AS n FROM cube WHERE model = 'm1' GROUP BY 1, 2 HAVING count(*) > 1", "cube")
def q02_duplicate_keys(spark, sf):
    """Keys with several rows."""
    c = D.cube(spark, sf).filter("model = 'm1'").withColumn("hour", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return Q.duplicate_keys(c, ["pair", "hour"])


@query("n_rows:i n_joined:i n_lag:i", f"SELECT (SELECT count(*) FROM ({_HDAILY})) AS n_rows, (SELECT count(*) FROM ({_HDAILY}) b LEFT JOIN ({_DAILY}) d ON b.pair = d.pair AND b.ts = d.trading_day) AS n_joined, 0 AS n_lag", "hourly clean_cube")
def q03_join_contract(spark, sf):
    """Whether the daily join multiplies rows or looks ahead."""
    bars = A.local_day_bars(D.hourly(spark, sf)).withColumnRenamed("day", "ts")
    daily = A.daily_prediction_features(D.clean_cube(spark, sf)).withColumn("made", F.date_sub("trading_day", 1))
    joined = J.attach_daily(bars, daily)
    return bars.agg(F.count("*").alias("n_rows")).crossJoin(joined.agg(F.count("*").alias("n_joined"), F.count_if(F.datediff("ts", "made") < 1).alias("n_lag")))


@query("pair:s n_back:i", "SELECT pair, sum(CASE WHEN t < b THEN 1 ELSE 0 END) AS n_back FROM (SELECT pair, t, lag(t) OVER (PARTITION BY pair ORDER BY event_id) AS b FROM (SELECT pair, prediction_available_timestamp AS t, event_id FROM cube)) GROUP BY pair HAVING sum(CASE WHEN t < b THEN 1 ELSE 0 END) > 0", "cube")
def q04_monotone(spark, sf):
    """Rows that arrived out of time order."""
    return Q.not_monotone(D.cube(spark, sf), ["pair"], "prediction_available_timestamp", "event_id")


@query("event_id:i pair:s", "SELECT event_id, pair FROM cube WHERE prediction_available_timestamp > timestamp", "cube")
def q05_acausal(spark, sf):
    """Predictions that came too late."""
    return D.cube(spark, sf).filter("prediction_available_timestamp > timestamp")


@query("field:s n_bad:i low:f high:f", 'SELECT \'signal_strength\' AS field, sum(CASE WHEN signal_strength NOT BETWEEN -1 AND 1 THEN 1 ELSE 0 END) AS n_bad, min(signal_strength) AS low, max(signal_strength) AS high FROM cube UNION ALL SELECT \'pred_prob_up\', sum(CASE WHEN pred_prob_up NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END), min(pred_prob_up), max(pred_prob_up) FROM cube', "cube")
def q06_ranges(spark, sf):
    """Values beyond their bounds."""
    return Q.out_of_range(D.cube(spark, sf), {"signal_strength": (-1.0, 1.0), "pred_prob_up": (0.0, 1.0)})


@query("dl_regime:s n:i", "SELECT dl_regime, count(*) AS n FROM cube WHERE dl_regime NOT IN ('HVTF', 'LVTF', 'HVMR', 'LVMR') GROUP BY 1", "cube")
def q07_vocabulary(spark, sf):
    """Regimes that are unknown."""
    return Q.outside_vocabulary(D.cube(spark, sf), "dl_regime", ["HVTF", "LVTF", "HVMR", "LVMR"])


@query("pair:s n_off:i", "SELECT pair, count(*) AS n_off FROM cube WHERE minute(timestamp) <> 0 OR second(timestamp) <> 0 GROUP BY 1", "cube")
def q07_off_hour(spark, sf):
    """Stamps off the hour."""
    return D.cube(spark, sf).filter((F.minute("timestamp") != 0) | (F.second("timestamp").cast("int") != 0)).groupBy("pair").agg(F.count("*").alias("n_off"))


@query("schema_version:s n:i ok:b", "SELECT schema_version, count(*) AS n, split_part(schema_version, '.', 1) = '2' AS ok FROM cube GROUP BY 1", "cube")
def q09_versions(spark, sf):
    """Schema versions and whether they fit."""
    return Q.incompatible_versions(D.cube(spark, sf), "schema_version", 2)


@query("state_id:s n:i", "SELECT dl_regime AS state_id, count(*) AS n FROM cube WHERE dl_regime NOT IN ('HVTF', 'LVTF', 'HVMR', 'LVMR', 'HVR', 'LVR') GROUP BY 1", "cube")
def q10_known_states(spark, sf):
    """States that the dimension does not have."""
    from tidemark.functions.expr import REGIME_TO_PHASE

    dim = spark.createDataFrame([(k,) for k in REGIME_TO_PHASE], "state_id string")
    return D.cube(spark, sf).withColumnRenamed("dl_regime", "state_id").join(dim, "state_id", "left_anti").groupBy("state_id").agg(F.count("*").alias("n"))


@query("n_folds:i n_unordered:i n_overlap:i", f"SELECT count(*) AS n_folds, sum(CASE WHEN test_start <= train_end OR test_end < test_start THEN 1 ELSE 0 END) AS n_unordered, sum(CASE WHEN test_start <= b THEN 1 ELSE 0 END) AS n_overlap FROM (SELECT *, lag(test_end) OVER (PARTITION BY pair ORDER BY fold) AS b FROM ({_FOLDS}))", "enriched")
def q11_fold_windows(spark, sf):
    """Folds out of order, and test spans that overlap."""
    f = _walk(spark, sf).withColumn("b", F.lag("test_end").over(Window.partitionBy("pair").orderBy("fold")))
    return f.agg(F.count("*").alias("n_folds"), F.count_if((F.col("test_start") <= F.col("train_end")) | (F.col("test_end") < F.col("test_start"))).alias("n_unordered"), F.count_if(F.col("test_start") <= F.col("b")).alias("n_overlap"))


@query("pair:s only_in:s", "SELECT pair, 'first' AS only_in FROM (SELECT pair FROM runs WHERE family = 'jpy' EXCEPT SELECT pair FROM runs WHERE family = 'eur') UNION ALL SELECT pair, 'second' FROM (SELECT pair FROM runs WHERE family = 'eur' EXCEPT SELECT pair FROM runs WHERE family = 'jpy')", "runs")
def q16_same_universe(spark, sf):
    """Pairs that one family lacks."""
    r = D.runs(spark, sf)
    return Q.missing_on_either_side(r.filter("family = 'jpy'"), r.filter("family = 'eur'"), ["pair"])


@query("pair:s n:i", "SELECT pair, count(*) AS n FROM bars GROUP BY pair HAVING count(*) < 2450", "bars")
def q17_minimum_bars(spark, sf):
    """Pairs with too few bars."""
    return Q.too_short(D.bars(spark, sf), "pair", 2450)


@query("pair:s ts:d only_in:s", "SELECT pair, ts, 'second' AS only_in FROM bars EXCEPT SELECT pair, entry_date, 'second' FROM trades", "bars trades")
def q18_same_index(spark, sf):
    """Dates that two tables do not share."""
    t = D.trades(spark, sf).select("pair", F.col("entry_date").alias("ts"))
    return Q.missing_on_either_side(t, D.bars(spark, sf), ["pair", "ts"])


@query("field:s mean:f std:f", 'SELECT \'rsi\' AS field, avg(rsi) AS mean, stddev_pop(rsi) AS std FROM enriched WHERE year(ts) < 2000', "enriched")
def m01_scaling(spark, sf):
    """Scaling parameters fitted on training rows only."""
    return D.enriched(spark, sf).filter(F.year("ts") < 2000).agg(F.avg("rsi").alias("mean"), F.stddev_pop("rsi").alias("std")).withColumn("field", F.lit("rsi"))
