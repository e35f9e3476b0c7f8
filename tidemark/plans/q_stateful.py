"""Queries: Wilder smoothing, ledgers, routing, bootstraps, models, files, archives and streams."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B
from tidemark.operators import ledger as L
from tidemark.operators import models as M
from tidemark.operators import router as R
from tidemark.operators import signals as S
from tidemark.operators import smoothing as X
from tidemark.operators import windows as W
from tidemark.plans import derive as D
from tidemark.plans.core import query
from tidemark.plans.q_tables import event_returns
from tidemark.sources import archive, files, sinks
from tidemark.storage import materialise, shared_folder
from tidemark.streaming import bars as ST
from tidemark.streaming import trading as TR


def _wilder(values: str, n: int = 14) -> str:
    """One step per bar: rows `pair, k, x` of `values` smoothed to `pair, k, y`."""
    return f"""WITH RECURSIVE v AS (SELECT pair, ts, x, row_number() OVER (PARTITION BY pair ORDER BY ts) AS k FROM ({values}) WHERE x IS NOT NULL),
        r AS (SELECT pair, CAST({n} AS BIGINT) AS k, avg(x) AS y FROM v WHERE k <= {n} GROUP BY pair HAVING count(*) = {n}
              UNION ALL SELECT r.pair, r.k + 1, (r.y * {n - 1} + v.x) / {n} FROM r JOIN v ON r.pair = v.pair AND v.k = r.k + 1) SELECT v.pair, v.ts, r.y FROM v LEFT JOIN r ON v.pair = r.pair AND v.k = r.k"""


@query("pair:s ts:d atr_share:g", f"SELECT w.pair, w.ts, w.y / b.close AS atr_share FROM ({_wilder('SELECT pair, ts, tr AS x FROM moves')}) w JOIN bars b USING (pair, ts)", "moves")
def s01_w16_wilder_atr(spark, sf):
    """Average true range after Wilder."""
    return X.wilder(W.true_range(D.bars(spark, sf)), {"tr": "atr"}, 14).withColumn("atr_share", F.col("atr") / F.col("close"))


@query(
    "pair:s ts:d rsi:f",
    f"SELECT g.pair, g.ts, 100 * g.y / nullif(g.y + l.y, 0) AS rsi FROM ({_wilder('SELECT pair, ts, CASE WHEN returns IS NOT NULL THEN gain END AS x FROM moves')}) g JOIN ({_wilder('SELECT pair, ts, CASE WHEN returns IS NOT NULL THEN loss END AS x FROM moves')}) l USING (pair, ts)", "moves",
)
def w15_wilder_rsi(spark, sf):
    """RSI after Wilder, of bars with a bar before."""
    return X.wilder_indicators(D.bars(spark, sf)).withColumn("n", F.row_number().over(W.by_time())).filter("n > 1")


def _directions(bars: str, moves: str) -> str:
    """Bars with Wilder range, directional indicators and their index, from the tables of those names."""
    part = lambda c: f"({_wilder(f'SELECT pair, ts, CASE WHEN returns IS NOT NULL THEN {c} END AS x FROM {moves}')})"
    return f"""SELECT b.*, a.y AS atr, a.y / b.close * 100 AS atr_pct, 100 * u.y / nullif(a.y, 0) AS plus_di, 100 * d.y / nullif(a.y, 0) AS minus_di, 100 * abs(u.y - d.y) / nullif(u.y + d.y, 0) AS dx
        FROM {bars} b LEFT JOIN ({_wilder(f'SELECT pair, ts, tr AS x FROM {moves}')}) a USING (pair, ts) LEFT JOIN {part('up')} u USING (pair, ts) LEFT JOIN {part('dn')} d USING (pair, ts)"""


def _adx(bars: str, moves: str) -> str:
    return f"SELECT i.*, x.y AS adx FROM ({_directions(bars, moves)}) i LEFT JOIN ({_wilder(f'SELECT pair, ts, dx AS x FROM ({_directions(bars, moves)})')}) x USING (pair, ts)"


_PHASE = "CASE WHEN high_vol THEN 'HV' ELSE 'LV' END || CASE WHEN trending THEN '_Trend' ELSE '_Ranging' END"
_DAILY = f"""SELECT *, CASE phase WHEN 'HV_Trend' THEN 2.5 WHEN 'LV_Trend' THEN 2.0 WHEN 'HV_Ranging' THEN 1.5 ELSE 1.0 END AS stop_atr_mult FROM (SELECT *, {_PHASE} AS phase FROM (
    SELECT *, coalesce(CASE WHEN count(atr_pct) OVER w >= 126 THEN atr_pct >= quantile_cont(atr_pct, 0.5) OVER w END, false) AS high_vol, coalesce(adx > 25, false) AS trending
    FROM ({_adx('bars', 'moves')}) WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 251 PRECEDING)))"""
_HOURLY = f"""SELECT *, {_PHASE} AS phase FROM (SELECT *, rel_vol >= 1 AS high_vol, coalesce(adx > 20, false) AS trending FROM (
    SELECT i.*, coalesce(s.y / nullif(l.y, 0), 2.0) AS rel_vol, CASE WHEN count(*) OVER w = 200 THEN avg(i.close) OVER w END AS sma200 FROM ({_adx('hourly', 'hmoves')}) i
    LEFT JOIN ({_wilder('SELECT pair, ts, tr AS x FROM hmoves', 10)}) s USING (pair, ts) LEFT JOIN ({_wilder('SELECT pair, ts, tr AS x FROM hmoves', 100)}) l USING (pair, ts) WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 199 PRECEDING)))"""


@query("pair:s ts:d plus_di:g minus_di:g adx:g", _adx("bars", "moves"), "moves")
def w17_wilder_adx(spark, sf):
    """Directional indicators and ADX after Wilder."""
    return X.wilder_indicators(D.bars(spark, sf))


@query("pair:s ts:t rel_vol:g", _HOURLY, "hmoves")
def w18_relative_volatility(spark, sf):
    """Short over long average range, hourly."""
    return X.hourly_regimes(D.hourly(spark, sf))


@query("pair:s ts:d atr:g adx:g high_vol:b trending:b phase:s stop_atr_mult:f", _DAILY, "moves")
def w35_daily_regimes(spark, sf):
    """Daily regime table."""
    return X.daily_regimes(D.bars(spark, sf))


@query("pair:s ts:t rel_vol:g adx:g sma200:g phase:s", _HOURLY, "hmoves")
def w36_hourly_regimes(spark, sf):
    """Hourly regime table."""
    return X.hourly_regimes(D.hourly(spark, sf))


@query(
    "pair:s ts:d phase:s detector_id:s config_version:s config_hash:s",
    f"""SELECT *, 'wilder_d1' AS detector_id, '1' AS config_version, sha256('{{"adx":25,"median":252,"n":14}}')[1:16] AS config_hash FROM ({_DAILY}) WHERE pair IN (SELECT pair FROM bars GROUP BY pair HAVING count(*) >= 300)""", "moves",
)
def w37_labelled_regimes(spark, sf):
    """Regimes of pairs with enough bars, with their detector and the digest of its configuration."""
    config = json.dumps({"n": 14, "median": 252, "adx": 25}, sort_keys=True, separators=(",", ":"))
    return X.labelled(X.daily_regimes(D.bars(spark, sf)), "wilder_d1", "1", hashlib.sha256(config.encode()).hexdigest()[:16])


def _long_signals(spark, sf, names=("TF3", "MR5", "MR1")):
    e = materialise(D.enriched(spark, sf))  # three strategies read it
    parts = None
    for name in names:
        one = S.STRATEGIES[name](e).select("pair", "ts", "high", "low", "close", "phase", "signal", "sl_pct", "tp_pct", F.lit(name).alias("strategy_id"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("pair:s strategy_id:s entry_date:d exit_date:d direction:i entry_price:f exit_price:f pnl_pct:f exit_reason:s")
def s03_ledger_trades(spark, sf):
    """Trades with stops and targets."""
    return L.ledger_trades(_long_signals(spark, sf))


@query("pair:s strategy_id:s ts:d equity:f")
def s03_equity(spark, sf):
    """Capital after each bar, with costs on both sides and a fixed share at risk."""
    e = D.enriched(spark, sf)
    rows = materialise(_long_signals(spark, sf).join(e.select("pair", "ts", "atr", F.lit(2.0).alias("stop_atr_mult")), ["pair", "ts"]))
    trades = materialise(L.ledger_trades(rows, costs=L.Costs(1.0, 0.5, 2.0, 0.01), risk=0.01))
    return L.equity_curve(rows, trades)


def _routed_input(spark, sf):
    e = S.all_signals(D.enriched(spark, sf), ["TF3", "MR5"])
    v = F.col("volume").cast("long")
    return e.select("pair", "ts", ((v % 100) / 100).alias("p_trend"), ((v * 7 % 100) / 100).alias("p_reversion"), (v % 17 == 0).alias("spike"), F.col("pair").endswith("F").alias("usd_quote"), F.col("phase").contains("Trend").alias("trending"), F.col("TF3").alias("trend_signal"), F.col("MR5").alias("reversion_signal"), F.lit(0.03).alias("trend_sl"), F.lit(0.06).alias("trend_tp"), F.lit(0.02).alias("reversion_sl"), F.lit(0.0).alias("reversion_tp"))


@query("pair:s policy:s ts:d selected:s switched:b held:i rule:s signal:f sl_pct:f tp_pct:f")
def s04_router(spark, sf):
    """Routed signals."""
    return R.route(_routed_input(spark, sf), {"default": R.Policy()})


#: Enter only, with a holding time, and with a lower threshold to leave as well.
_POLICIES = {"enter": R.Policy(leave=0.55, min_hold=0), "enter_hold": R.Policy(leave=0.55, min_hold=5), "enter_leave_hold": R.Policy(leave=0.5, min_hold=5)}


@query("policy:s pair:s fold:i n_switches:i n_active:i n_trades:i mean_pnl:f")
def s10_policy_sweep(spark, sf):
    """Six thresholds and three policies over the same half-year folds in one pass, routed and traded."""
    thresholds = {f"tau{t}": R.Policy(enter=t / 100, leave=t / 100 - 0.1) for t in (50, 55, 60, 65, 70, 75)}
    half = (F.year("ts") * 2 + F.when(F.month("ts") > 6, 1).otherwise(0)).cast("int").alias("fold")
    keys = ["pair", "fold"]
    swept = materialise(R.route(_routed_input(spark, sf).select("*", half), thresholds | _POLICIES, keys))
    bars = D.enriched(spark, sf).select("pair", "ts", "high", "low", "close", "phase")
    trades = L.ledger_trades(swept.join(bars, ["pair", "ts"]), keys=[*keys, "policy"])
    traded = trades.groupBy(*keys, "policy").agg(F.count("*").alias("n_trades"), F.avg("pnl_pct").alias("mean_pnl"))
    routed = swept.groupBy(*keys, "policy").agg(F.count_if("switched").alias("n_switches"), F.count_if(F.col("signal") != 0).alias("n_active"))
    return routed.join(traded, [*keys, "policy"], "left").fillna(0, ["n_trades"])


def _weekly(spark, sf):
    return event_returns(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "entry_time")))


@query("phase:s horizon:s ci_low:f ci_high:f replicates:i")
def a23_bootstrap_mean(spark, sf):
    """Week-block interval of the mean."""
    return B.mean_interval(_weekly(spark, sf), ["phase", "horizon"], "x", "week", 500)


@query("phase:s horizon:s ci_low:f ci_high:f replicates:i")
def a23_bootstrap_mean_multiplicity(spark, sf):
    """The same, weeks counted as often as drawn."""
    return B.mean_interval(_weekly(spark, sf), ["phase", "horizon"], "x", "week", 500, multiplicity=True)


@query("phase:s horizon:s statistic:s ci_low:f ci_high:f replicates:i")
def a23_bootstrap_statistics(spark, sf):
    """Week-block intervals of the share of gains, gains over losses, and the mean without the outer tenths."""
    x = F.col("x")
    kinds = {"share": B.ratio_of(F.when(x > 0, 1.0).when(x <= 0, 0.0), F.when(x.isNotNull(), 1)), "profit_factor": B.ratio_of(F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))), "trimmed": B.trimmed_mean_of("x", 0.1, 0.001)}
    w = materialise(_weekly(spark, sf))
    parts = [B.interval(w, ["phase", "horizon"], kind, "week", 300, multiplicity=True).withColumn("statistic", F.lit(name)) for name, kind in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("phase:s horizon:s ci_low:f ci_high:f mean_diff:f")
def a24_j18_bootstrap_difference(spark, sf):
    """Week-block interval of a difference of pair means."""
    return B.difference_interval(_weekly(spark, sf).withColumn("is_click", F.col("pair") == "click"), ["phase", "horizon"], "is_click", "x", "week", 300)


_FEATURES = ["rsi", "adx", "atr_pct", "returns"]


def _model_rows(spark, sf):
    rows = D.enriched(spark, sf).dropna(subset=[*_FEATURES, "next_return"]).withColumn("up", (F.col("next_return") > 0).cast("double"))
    return materialise(rows)


_PHASES = ["HV_Trend", "LV_Trend", "HV_Ranging", "LV_Ranging"]


@query("fold:i accuracy:f n:i accuracy_mean:f accuracy_std:f")
def m02_time_series_cv(spark, sf):
    """Expanding cross-validation of the direction, with mean and deviation over the folds."""
    return M.cross_validated(_model_rows(spark, sf), _FEATURES, "up")


@query("variant:s phase:s accuracy_mean:f accuracy_std:f n:i")
def m03_direction_variants(spark, sf):
    """Direction without phases, with phases as features, and by a model for each phase."""
    return M.direction_variants(_model_rows(spark, sf), _FEATURES, _PHASES, "up", splits=3)


@query("variant:s accuracy:f n:i difference:f")
def m03_compared_forests(spark, sf):
    """The three variants by random forests, and how much the phases change."""
    rows = materialise(_model_rows(spark, sf))
    return M.compared_variants(M.direction_variants(rows, _FEATURES, _PHASES, "up", splits=2, learner="forest"))


@query("pair:s ts:d phase:s predicted:s learned:b")
def m04_next_phase(spark, sf):
    """Next phase, walking forward."""
    return M.walk_forward_phases(D.enriched(spark, sf), _FEATURES, _PHASES)


def _typed(spark, sf):
    """Rows with the type that the next bar would have rewarded; none where it hardly moved."""
    moved = F.abs("next_return") > F.col("atr_pct") / 1000
    best = F.when(~moved, "none").when(F.col("returns") * F.col("next_return") > 0, "trend").otherwise("reversion")
    return _model_rows(spark, sf).withColumn("best", best)


@query("pair:s ts:d selected:s p_none:f p_reversion:f p_trend:f")
def m05_type_selector(spark, sf):
    """Three-class probabilities in one pass, by a selector trained on the first two thirds of each pair's bars."""
    from pyspark.sql.window import Window

    rows = _typed(spark, sf).withColumn("third", F.ntile(3).over(Window.partitionBy("pair").orderBy("ts")))
    return M.TypeSelector.train(rows.filter("third < 3"), _FEATURES, "best").probabilities(rows.filter("third = 3"))


@query("fold:i accuracy:f n:i")
def m05_stratified_cv(spark, sf):
    """Accuracy of the selector over stratified folds."""
    return M.stratified_accuracy(_typed(spark, sf), _FEATURES, "best")


@query("year:i experiment:s accuracy:f mean_return:f hit_rate:f sharpe:f n_trades:i")
def m06_yearly_regression(spark, sf):
    """Logistic regression of all earlier years, tested on each year, for three feature sets."""
    return M.yearly_experiments(_model_rows(spark, sf), {"oscillator": ["rsi", "returns"], "range": ["adx", "atr_pct"], "all": _FEATURES}, "up", "next_return")


@query("feature:s importance:f")
def t08_importances(spark, sf):
    """What the selector looks at."""
    return M.importances(M.fit_types(_typed(spark, sf), _FEATURES, "best"), _FEATURES, spark)


# files and archives: written from the tables first, then read as they would be found


def _folder(spark) -> str:
    path = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def _write_named(rows, path: str, order: list[str]) -> None:
    """Rows as CSV files, each named by its column `file`, in the order of `order` (dropped)."""
    kept = [c for c in rows.columns if c not in order]
    rows.repartition("file").sortWithinPartitions("file", *order).select(*kept).write.mode("append").partitionBy("file").option("header", True).csv(path)


@query(
    "pair:s ts:t open:f high:f low:f close:f volume:f", "SELECT event_type[1:3] || '-usd' AS pair, ts, open, high, low, close, volume FROM (SELECT pair AS event_type, * EXCLUDE (pair) FROM hourly)", "hourly",
)
def src01_src02_hourly_csv(spark, sf):
    """Hourly bars of all pairs from CSV files with columns in different orders, bad rows, repeated stamps and files of lower rank."""
    path = _folder(spark)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    code = F.concat(F.upper(F.substring("pair", 1, 3)), F.lit("USD"))
    b = materialise(D.hourly(spark, sf).select(code.alias("code"), stamp.alias("stamp"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume")))
    prices = ["open", "high", "low", "close"]
    # before each bar one of the same stamp, one without a stamp and one without a price
    bad = b.withColumnRenamed("stamp", "at").select("code", "at", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))).alias("turn"), *prices, "volume")
    rows = bad.select(
        "code", F.col("at"), "turn", F.when(F.col("turn") == 1, "bad").otherwise(F.col("at")).alias("stamp"),
        F.when(F.col("turn") == 0, "0").when(F.col("turn") == 2, "x").otherwise(F.col("open").cast("string")).alias("open"), "high", "low", "close", "volume",
    )
    first = rows.filter("code < 'L'").select(F.concat("code", F.lit("60.csv")).alias("file"), F.col("stamp").alias("time_utc"), *prices, F.col("volume").alias("tick_volume"), "at", "turn")
    other = rows.filter("code >= 'L'").select(F.concat("code", F.lit("_H1.csv")).alias("file"), "volume", "close", F.col("low").alias(" Low "), "high", F.col("open").alias("OPEN"), F.col("stamp").alias("Time"), "at", "turn")
    _write_named(first, path, ["at", "turn"])
    _write_named(other, path, ["at", "turn"])
    lower = b.select(F.concat("code", F.lit(".csv")).alias("file"), F.col("stamp").alias("date"), *[F.lit(1.0).alias(c) for c in prices], F.lit(1).alias("volume"))
    _write_named(lower, path, [])
    return files.hourly_bars(spark, path)


@query("pair:s ts:d open:f close:f volume:f", "SELECT lower(pair) || 'x-usd' AS pair, ts, open, close, CASE WHEN pair LIKE '%F' THEN 0.0 ELSE volume END AS volume FROM bars", "bars")
def src03_snk01_daily_parquet(spark, sf):
    """Daily bars from CSV files, some without volume, through the partitioned sink and back."""
    path, parquet = _folder(spark), _folder(spark)
    b = D.bars(spark, sf).withColumn("file", F.concat("pair", F.lit("xUSD.csv"))).withColumn("date", F.date_format("ts", "yyyy-MM-dd 12:30:00"))
    prices = ["open", "high", "low", "close"]
    _write_named(b.filter(F.col("pair").endswith("F")).select("file", "date", *prices), path, [])
    _write_named(b.filter(~F.col("pair").endswith("F")).select("file", "volume", *prices, "date"), path, [])
    sinks.write_results(files.daily_bars(spark, path), parquet, "baseline")
    return spark.read.parquet(parquet)


@query(
    "evaluation_id:s surface_id:s surface_version:s state_id:s strategy_id:s expected_return:f expected_sharpe:f expected_drawdown:f win_rate:f confidence:f stability:f n_folds:i n_trades:i metadata:s",
    """SELECT *, 'eval_' || sha256('{"experiment_id":"exp_half_years","schema_version":"1.0.0","state_id":"all","strategy_id":"' || strategy_id || '","surface_id":"bars","surface_version":"1"}')[1:24] AS evaluation_id,
       'bars' AS surface_id, '1' AS surface_version, 'all' AS state_id, NULL AS confidence, '{"kind":"' || split_part(strategy_id, '_', 1) || '"}' AS metadata FROM evals""", "evals",
)
def snk02_evaluations(spark, sf):
    """Evaluations written in their 14 columns, and read."""
    path = _folder(spark)
    rows = D.evaluations(spark, sf).withColumn("kind", F.split("strategy_id", "_")[0])
    sinks.write_evaluations(sinks.evaluation_records(rows, "bars", "1", "all", "exp_half_years"), path)
    return spark.read.parquet(path)


_RECOMMENDED = """SELECT *, 'rec_' || sha256('{"evaluation_id":"' || evaluation_id || '","rank":' || rank || ',"recommendation_policy":"sharpe","schema_version":"1.0.0"}')[1:24] AS recommendation_id FROM (
    SELECT row_number() OVER (ORDER BY expected_sharpe DESC NULLS LAST, expected_return DESC NULLS LAST, strategy_id) AS rank, 'sharpe' AS recommendation_policy,
           'eval_' || sha256('{"experiment_id":"exp_half_years","schema_version":"1.0.0","state_id":"all","strategy_id":"' || strategy_id || '","surface_id":"bars","surface_version":"1"}')[1:24] AS evaluation_id FROM evals)"""


def _recommended(spark, sf):
    """Evaluation records with their rank."""
    from tidemark.operators.ranking import ranked_recommendations

    return ranked_recommendations(sinks.evaluation_records(D.evaluations(spark, sf), "bars", "1", "all", "exp_half_years"))


@query("rank:i recommendation_policy:s evaluation_id:s recommendation_id:s", _RECOMMENDED, "evals")
def snk03_recommendations(spark, sf):
    """Recommendations written and read; their evaluations are those that are written."""
    path = _folder(spark)
    sinks.write_recommendations(_recommended(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "problem:s recommendation_id:s",
    f"""WITH planted AS (SELECT CASE WHEN rank % 9 = 0 THEN 'rec_same' ELSE recommendation_id END AS recommendation_id, CASE WHEN rank % 7 = 3 THEN 'eval_none' WHEN rank % 7 = 5 THEN '' ELSE evaluation_id END AS evaluation_id,
            CASE WHEN rank = 1 THEN 0 WHEN rank % 5 = 0 THEN rank - 1 ELSE rank END AS rank, recommendation_policy, CASE WHEN rank % 6 = 1 THEN '0.9' ELSE '1.0.0' END AS version FROM ({_RECOMMENDED}))
        SELECT 'empty' AS problem, recommendation_id FROM planted WHERE evaluation_id = '' UNION ALL SELECT 'rank', recommendation_id FROM planted WHERE rank < 1
        UNION ALL SELECT 'same_id', recommendation_id FROM (SELECT *, count(*) OVER (PARTITION BY recommendation_id) AS n FROM planted) WHERE n > 1
        UNION ALL SELECT 'same_rank', recommendation_id FROM (SELECT *, count(*) OVER (PARTITION BY rank) AS n FROM planted) WHERE n > 1
        UNION ALL SELECT 'version', recommendation_id FROM planted WHERE version <> '1.0.0' UNION ALL SELECT 'unknown', recommendation_id FROM planted WHERE evaluation_id IN ('eval_none', '')""", "evals",
)
def q14_recommendation_set(spark, sf):
    """Six contracts of a recommendation set, over one with violations of each."""
    from tidemark.operators import quality

    path, k = _folder(spark), F.col("rank")
    records = sinks.evaluation_records(D.evaluations(spark, sf), "bars", "1", "all", "exp_half_years")
    sinks.write_recommendations(_recommended(spark, sf), path)
    planted = spark.read.parquet(path).select(
        F.when(k % 9 == 0, "rec_same").otherwise(F.col("recommendation_id")).alias("recommendation_id"), F.when(k % 7 == 3, "eval_none").when(k % 7 == 5, "").otherwise(F.col("evaluation_id")).alias("evaluation_id"),
        F.when(k == 1, 0).when(k % 5 == 0, k - 1).otherwise(k).alias("rank"), "recommendation_policy", F.when(k % 6 == 1, F.lit('{"schema_version":"0.9"}')).otherwise(F.col("metadata")).alias("metadata"),
    )
    return quality.recommendation_problems(planted, records, [sinks.RECOMMENDATION_VERSION])


@query("pair:s ts:d phase:s", "SELECT * FROM enriched", "enriched")
def snk04_phase_labels(spark, sf):
    """Phase labels and gaps written, labels read."""
    path = _folder(spark)
    e = D.enriched(spark, sf)
    sinks.write_phase_labels(e.select("pair", "ts", "phase"), W.gap_days(D.bars(spark, sf)).filter("gap_days > 1").select("pair", "ts", "gap_days"), path)
    return spark.read.parquet(f"{path}/labels")


def _archive(spark, sf) -> str:
    """An archive, all written by Spark: per run a folder with a manifest and result files, whose columns are in two orders and names."""
    root = _folder(spark)
    r = materialise(D.runs(spark, sf))
    manifest = F.to_json(F.struct(F.struct(F.col("run_id").alias("id")).alias("run"), F.struct("generation", F.create_map(F.lit("family"), F.col("family"), F.lit("aware"), F.col("aware").cast("string")).alias("factors")).alias("experiment")))
    named = r.select("run_id", F.lit("run_manifest.json").alias("file"), "generation", "family", "aware").distinct().select("run_id", "file", manifest.alias("value"))
    named.repartition("run_id").write.mode("append").partitionBy("run_id", "file").text(root)
    # folders with two manifests, and folders with results only
    double = r.select("family").distinct().select(F.concat(F.lit("double_"), "family").alias("run_id"), F.explode(F.array(F.lit("run_manifest_1.json"), F.lit("run_manifest_2.json"))).alias("file"), F.lit("{}").alias("value"))
    double.write.mode("append").partitionBy("run_id", "file").text(root)
    strategy = F.when(F.col("row_id") % 3 == 0, "PhaseAware_TF4").otherwise("TF1").alias("strategy")
    rows = r.select("run_id", F.lit("walkforward_results_per_pair__baseline.csv").alias("file"), "pair", "sharpe", "ret", strategy, (F.col("generation") == "gen1").alias("older"))
    older = rows.filter("older").select("run_id", "file", "pair", F.col("sharpe").alias("Dynamic Sharpe"), F.col("ret").alias("Baseline Sharpe"), "strategy")
    newer = rows.filter("not older").select("run_id", "file", "strategy", F.col("ret").alias("Sharpe_Baseline"), F.col("sharpe").alias("Sharpe_Dynamic"), F.col("pair").alias("Pair"))
    legacy = r.select("generation", "pair").distinct().select(F.concat(F.lit("old_"), "generation").alias("run_id"), F.lit("results.csv").alias("file"), "pair")
    for part in (older, newer, legacy):
        part.repartition("run_id").write.mode("append").partitionBy("run_id", "file").option("header", True).csv(root)
    return root


_RESULTS = {"pair": "string", "strategy": "string", "sharpe_dynamic": "double", "sharpe_baseline": "double", "return_dynamic": "double"}


@query(
    "run_id:s mode:s n:i mean_sharpe:f mean_baseline:f n_returns:i n_ambiguous:i",
    """SELECT run_id, 'baseline' AS mode, count(*) AS n, avg(sharpe) AS mean_sharpe, avg(ret) AS mean_baseline, 0 AS n_returns, coalesce(any_value(k), 0) AS n_ambiguous
       FROM runs LEFT JOIN (SELECT run_id, sum(c) AS k FROM (SELECT run_id, count(*) AS c FROM runs WHERE row_id % 3 = 0 GROUP BY run_id, pair HAVING count(*) > 1) GROUP BY run_id) USING (run_id) GROUP BY run_id""", "runs",
)
def src12_src14_result_tables(spark, sf):
    """Result files of all runs in one scan, by column name and older names, and the phase-aware rows that are not one for a pair."""
    rows = archive.result_tables(spark, _archive(spark, sf), "walkforward_results_per_pair", _RESULTS)
    unsure = archive.one_router_row(rows).filter("ambiguous").groupBy("run_id").agg(F.count("*").alias("n_ambiguous"))
    means = rows.groupBy("run_id", "mode").agg(F.count("*").alias("n"), F.avg("sharpe_dynamic").alias("mean_sharpe"), F.avg("sharpe_baseline").alias("mean_baseline"), F.count("return_dynamic").alias("n_returns"))
    return means.join(unsure, "run_id", "left").fillna(0, ["n_ambiguous"])


@query("name:s family:s aware:b", "SELECT DISTINCT generation || '_' || family || CASE WHEN aware THEN '_aware' ELSE '_blind' END AS name, family, aware FROM runs", "runs")
def src15_names(spark, sf):
    """What experiment names tell."""
    n = D.runs(spark, sf).select(F.concat("generation", F.lit("_"), "family", F.when(F.col("aware"), "_aware").otherwise("_blind")).alias("name")).distinct()
    return archive.experiments_from_names(n)


@query("pair:s fold:i n_bars:i sharpe:f", "SELECT pair, fold, n_bars, sharpe_dynamic AS sharpe FROM folds", "folds")
def src16_debug_series(spark, sf):
    """Series of single folds, named by pair and fold."""
    path = _folder(spark)
    named = F.concat(F.lit("debug_"), "pair", F.lit("_fold"), "fold", F.lit(".csv"))
    _write_named(D.folds(spark, sf).select(named.alias("file"), "n_bars", "sharpe_dynamic"), path, [])
    return files.debug_series(spark, path).select("pair", "fold", F.col("row")["n_bars"].alias("n_bars"), F.col("row")["sharpe_dynamic"].cast("double").alias("sharpe"))


# streams: read once to the end, each the twin of a batch query


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def _run(spark, df, mode="append", path=None):
    """Run a stream over all that is there, into a table in the shared folder, and read that."""
    path = path or _folder(spark)
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


_LAST = "SELECT max(ts) FROM events"


@query("pair:s day:d open:f high:f low:f close:f volume:i", f"SELECT pair, day, open, high, low, close, volume FROM (SELECT event_type AS pair, CAST(ts + INTERVAL 1 HOUR AS DATE) AS day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2) WHERE CAST(day AS TIMESTAMP) + INTERVAL 23 HOUR <= ({_LAST}) - INTERVAL 2 HOUR")
def st01_day_bars(spark, sf):
    """Daily bars of a stream; days still open are not given out."""
    return _run(spark, ST.day_bars(_stream(spark, sf)))


@query("pair:s trading_day:d dl_signal_mean_24h:f dl_signal_std_24h:f dl_signal_last:f dl_signal_abs_mean:f", f"SELECT * FROM (SELECT event_type AS pair, CAST(ts AS DATE) + 1 AS trading_day, avg(value / 50 - 1) AS dl_signal_mean_24h, coalesce(stddev_samp(value / 50 - 1), 0) AS dl_signal_std_24h, arg_max(value / 50 - 1, ts) AS dl_signal_last, avg(abs(value / 50 - 1)) AS dl_signal_abs_mean FROM events GROUP BY 1, 2) WHERE CAST(trading_day AS TIMESTAMP) <= ({_LAST}) - INTERVAL 2 HOUR")
def st02_day_features(spark, sf):
    """Prediction features of a stream, given out for the next day."""
    return _run(spark, ST.day_features(_stream(spark, sf).withColumn("signal", F.col("price") / 50 - 1)))


@query("event_id:i pair:s", "SELECT event_id, event_type AS pair FROM events WHERE event_id % 97 = 0")
def st03_quarantine(spark, sf):
    """Predictions that came too late, set aside by each micro-batch."""
    path = _folder(spark)
    good, bad = f"{path}/good", f"{path}/bad"
    s = _stream(spark, sf).withColumn("available_ts", F.when(F.col("event_id") % 97 == 0, F.expr("ts + INTERVAL 10 MINUTES")).otherwise(F.expr("ts - INTERVAL 5 MINUTES")))
    q = s.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: ST.split_acausal(b, good, bad)).start()
    q.awaitTermination()
    return spark.read.parquet(bad)


@query("pair:s ts:t n:i", "SELECT DISTINCT event_type AS pair, ts, 1 AS n FROM events")
def st04_without_duplicates(spark, sf):
    """A stream that gives each key (pair and time, whatever the event) at least twice, each kept once."""
    twice = _stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, ST.without_duplicates(twice, ["pair", "ts"]).select("pair", "ts", F.lit(1).alias("n")))


@query("pair:s start:t mean:f std:f n:i", f"SELECT pair, start, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM (SELECT event_type AS pair, value, ts, unnest(range(0, 6)) AS k, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start FROM (SELECT * FROM events) e) GROUP BY 1, 2 HAVING start + INTERVAL 6 HOUR <= ({_LAST}) - INTERVAL 2 HOUR")
def st05_sliding(spark, sf):
    """Statistics over sliding windows of a stream."""
    return _run(spark, ST.sliding(_stream(spark, sf)))


@query("pair:s start:t stop:t n:i", f"SELECT pair, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT event_type AS pair, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events)) GROUP BY pair, g HAVING max(ts) + INTERVAL 30 MINUTE <= ({_LAST}) - INTERVAL 2 HOUR")
def st06_sessions(spark, sf):
    """Sessions of a stream."""
    return _run(spark, ST.sessions(_stream(spark, sf)))


@query("pair:s ts:t position:i n_seen:i", "SELECT event_type AS pair, ts, coalesce(last_value(CASE WHEN value > 90 THEN 1 WHEN value < 10 THEN 0 END IGNORE NULLS) OVER w, 0) AS position, row_number() OVER w AS n_seen FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def st07_held_positions(spark, sf):
    """Positions kept as state per pair; events of one time in the order of their ids."""
    path = _folder(spark)
    s = _stream(spark, sf).select("pair", "ts", F.col("event_id").alias("seq"), F.when(F.col("price") > 90, 1).when(F.col("price") < 10, 0).alias("event"))
    q = s.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: ST.held_positions(b, n, path)).start()
    q.awaitTermination()
    return spark.read.schema(ST.POSITION).parquet(f"{path}/rows")


@query("pair:s entry_date:d exit_date:d direction:i entry_price:f exit_price:f pnl_pct:f exit_reason:s")
def st07_router_ledger(spark, sf):
    """Trades of routed bars, from a stream that keeps router and ledger as state, stopped once and started again."""
    path = _folder(spark)
    bars = _routed_input(spark, sf).join(D.enriched(spark, sf).select("pair", "ts", "high", "low", "close", "phase"), ["pair", "ts"])
    bars = materialise(bars.select(*[F.col(c).cast("double" if c.startswith(("p_", "trend_", "reversion_")) else dict(bars.dtypes)[c]).alias(c) for c in bars.columns if c != "ts"], F.col("ts").cast("timestamp").alias("ts")))
    later = F.year("ts") >= 1995
    with TR.with_timers(spark):
        for part in (bars.filter(~later), bars.filter(later)):  # each run begins where the one before stopped
            part.write.mode("append").parquet(f"{path}/in")
            out = _run(spark, TR.traded(spark.readStream.schema(bars.schema).parquet(f"{path}/in")), path=path)
    return out.filter("kind = 'trade'").withColumn("exit_date", F.col("ts"))


@query("event_id:i pair:s label:s", "SELECT event_id, event_type AS pair, r_name AS label FROM events LEFT JOIN region ON event_id % 7 = r_regionkey")
def st08_stream_static(spark, sf):
    """A stream joined with a static table."""
    dim = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("label"))
    return _run(spark, ST.enriched(_stream(spark, sf).withColumn("k", F.col("event_id") % 7), dim, "k").select("event_id", "pair", "label"))
