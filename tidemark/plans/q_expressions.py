"""Queries: projections, predicates and scalar expressions (PF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import windows as W
from tidemark.plans import derive as D
from tidemark.plans.core import query

_PHASES = ["HV_Trend", "LV_Trend", "HV_Ranging", "LV_Ranging"]


@query("pair:s ts:d open:f high:f low:f close:f volume:f", "SELECT * FROM bars WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL", "bars")
def pf01_ohlcv(spark, sf):
    """Bars with complete prices."""
    return D.bars(spark, sf).select("pair", "ts", "open", "high", "low", "close", "volume").dropna(subset=["open", "high", "low", "close"])


@query("pair:s n:i", "SELECT pair, count(*) AS n FROM bars WHERE upper(pair) IN ('AF', 'NO') GROUP BY pair", "bars")
def pf02_pair_universe(spark, sf):
    """Bars of chosen pairs, whatever their case."""
    return D.bars(spark, sf).filter(F.upper("pair").isin(*map(str.upper, ("af", "No")))).groupBy("pair").agg(F.count("*").alias("n"))


@query("pair:s ts:d close:f", "SELECT * FROM bars WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'", "bars")
def pf03_date_range(spark, sf):
    """Bars of a span of days, both ends included."""
    return D.bars(spark, sf).filter(F.col("ts").between(F.lit("1997-03-01").cast("date"), F.lit("1997-06-30").cast("date")))


_RAW = "SELECT c_custkey, (['EURUSD','eur/usd',' gbp_jpy','usd--chf','EURUSD60.csv','bad','USDJPY'])[c_custkey % 7 + 1] AS raw FROM customer"
_NORM = """SELECT *, CASE WHEN regexp_matches(s, '^[a-z]{3}-[a-z]{3}$') THEN s END AS pair FROM (SELECT *, CASE WHEN regexp_matches(d, '^[a-z]{6}$') THEN d[1:3] || '-' || d[4:6] ELSE d END AS s FROM (
    SELECT *, regexp_replace(regexp_replace(lower(trim(raw)), '[/_]', '-', 'g'), '-+', '-', 'g') AS d FROM (%s)))""" % _RAW


def _raw_pairs(spark, sf):
    names = F.array(*map(F.lit, ("EURUSD", "eur/usd", " gbp_jpy", "usd--chf", "EURUSD60.csv", "bad", "USDJPY")))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int")).alias("raw"))


@query("c_custkey:i pair:s compact:s", f"SELECT c_custkey, pair, upper(replace(pair, '-', '')) AS compact FROM ({_NORM})")
def pf04_normalised_pair(spark, sf):
    """Pair names in one form, and back."""
    return _raw_pairs(spark, sf).withColumn("pair", X.normalised_pair(F.col("raw"))).withColumn("compact", X.compact_pair(F.col("pair")))


@query(
    "compact:s role:s is_jpy:b pip:f n:i",
    f"""SELECT compact, CASE WHEN suffix(compact, 'USD') THEN 'quote' WHEN prefix(compact, 'USD') THEN 'base' WHEN contains(compact, 'USD') THEN 'cross' ELSE 'none' END AS role, suffix(compact, 'JPY') AS is_jpy,
        CASE WHEN suffix(compact, 'JPY') THEN 0.01 ELSE 0.0001 END AS pip, count(*) AS n FROM (SELECT upper(replace(pair, '-', '')) AS compact FROM ({_NORM}) WHERE pair IS NOT NULL) GROUP BY compact""",
)
def pf05_pair_roles(spark, sf):
    """Role of USD, yen flag and pip size."""
    d = _raw_pairs(spark, sf).select(X.compact_pair(X.normalised_pair(F.col("raw"))).alias("compact")).dropna().groupBy("compact").agg(F.count("*").alias("n"))
    return d.withColumns({"role": X.usd_role(F.col("compact")), "is_jpy": F.col("compact").endswith("JPY"), "pip": X.pip_value(F.col("compact"))})


@query("c_custkey:i pip:f", "SELECT c_custkey, coalesce(pip, 0.0001) AS pip FROM customer LEFT JOIN (SELECT n_nationkey, 0.01 AS pip FROM nation WHERE n_regionkey = 2) ON c_nationkey = n_nationkey")
def pf06_pip_lookup(spark, sf):
    """Pip size from a dimension of fixed size, with a default."""
    dim = spark.read.parquet(f"{sf}/nation.parquet").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(0.01).alias("pip"))
    return spark.read.parquet(f"{sf}/customer.parquet").join(dim, "c_nationkey", "left").select("c_custkey", F.coalesce("pip", F.lit(0.0001)).alias("pip"))


@query("pair:s entry_time:t abs_sentiment:f streak:i", "SELECT * FROM sentiment WHERE abs_sentiment >= 70 AND streak >= 3", "sentiment")
def pf07_event_filter(spark, sf):
    """Events of the registered kind."""
    return D.sentiment(spark, sf).filter("abs_sentiment >= 70 and streak >= 3")


@query("pair:s ts:d phase:s", "SELECT * FROM enriched", "enriched")
def pf08_phase(spark, sf):
    """Phase from two flags, NULL as false."""
    return D.enriched(spark, sf)


@query(
    "pair:s ts:d stop:f size:f",
    "SELECT pair, ts, CASE phase WHEN 'HV_Trend' THEN 2.5 WHEN 'LV_Trend' THEN 2.0 WHEN 'HV_Ranging' THEN 1.5 ELSE 1.0 END AS stop, CASE phase WHEN 'HV_Trend' THEN 0.5 WHEN 'LV_Trend' THEN 1.0 WHEN 'HV_Ranging' THEN 0.5 ELSE 0.75 END AS size FROM enriched", "enriched",
)
def pf09_phase_maps(spark, sf):
    """Stop and size of each phase."""
    return D.enriched(spark, sf).withColumns({"stop": X.lookup(X.PHASE_STOP_ATR, F.col("phase")), "size": X.lookup(X.PHASE_SIZE, F.col("phase"))})


@query("dl_regime:s phase:s n:i", "SELECT dl_regime, coalesce((MAP {'HVTF':'HV_Trend','LVTF':'LV_Trend','HVMR':'HV_Ranging','LVMR':'LV_Ranging'})[dl_regime], dl_regime) AS phase, count(*) AS n FROM cube GROUP BY 1, 2", "cube")
def pf10_regime_vocabulary(spark, sf):
    """Regime names as phases; unknown ones pass."""
    d = D.cube(spark, sf).groupBy("dl_regime").agg(F.count("*").alias("n"))
    return d.withColumn("phase", F.coalesce(X.lookup(X.REGIME_TO_PHASE, F.col("dl_regime")), "dl_regime"))


@query(
    "surface_id:s surface_version:s state_id:s n:i",
    "SELECT coalesce(nullif(trim(surface_id), ''), 'trend_vol') AS surface_id, '1' AS surface_version, coalesce((MAP {'HVTF':'HV_Trend','LVTF':'LV_Trend','HVMR':'HV_Ranging','LVMR':'LV_Ranging'})[dl_regime], dl_regime) AS state_id, count(*) AS n FROM cube GROUP BY 1, 2, 3", "cube",
)
def pf11_identity(spark, sf):
    """Surface, version and state, filled from the legacy regime."""
    d = D.cube(spark, sf).withColumns(X.identity(F.col("surface_id"), F.lit(None).cast("string"), F.lit(""), F.col("dl_regime")))
    return d.groupBy("surface_id", "surface_version", "state_id").agg(F.count("*").alias("n"))


@query("pair:s entry_time:t flag:i", "SELECT *, CASE WHEN pair = 'click' AND streak >= 3 AND abs_sentiment >= 70 THEN 1 ELSE 0 END AS flag FROM sentiment", "sentiment")
def pf12_composite_flag(spark, sf):
    """A flag of several conditions."""
    return D.sentiment(spark, sf).withColumn("flag", ((F.col("pair") == "click") & (F.col("streak") >= 3) & (F.col("abs_sentiment") >= 70)).cast("int"))


@query("pair:s ts:d target:i", "SELECT pair, ts, CAST(next_return > 0 AS INTEGER) AS target FROM rets", "rets")
def pf13_binary_target(spark, sf):
    """Whether the next return is positive."""
    return W.returns(D.bars(spark, sf)).withColumn("target", (F.col("next_return") > 0).cast("int"))


@query("pair:s ts:d adx:f dl_extra:f rsi:f", "SELECT pair, ts, adx, CAST(NULL AS DOUBLE) AS dl_extra, rsi FROM enriched", "enriched")
def pf14_feature_projection(spark, sf):
    """Feature groups, with an optional column that is not there."""
    return X.feature_projection(D.enriched(spark, sf), {"base": ["rsi", "adx"], "dl": ["dl_extra"]}, ["base", "dl"], {"rsi"})


@query("pair:s ts:d rsi:f adx:f", "SELECT * FROM enriched WHERE next_return IS NOT NULL AND rsi IS NOT NULL AND adx IS NOT NULL", "enriched")
def pf16_required_rows(spark, sf):
    """Rows with target and required features."""
    return D.enriched(spark, sf).dropna(subset=["next_return", "rsi", "adx"])


@query("pair:s ts:d rsi:f rsi_missing:i adx:f adx_missing:i", "SELECT pair, ts, coalesce(rsi, 0) AS rsi, CAST(rsi IS NULL AS INTEGER) AS rsi_missing, coalesce(adx, 0) AS adx, CAST(adx IS NULL AS INTEGER) AS adx_missing FROM enriched", "enriched")
def pf17_imputation(spark, sf):
    """Zeros for gaps, and where they were."""
    return X.impute(D.enriched(spark, sf), ["rsi", "adx"])


@query("pair:s ts:d phase_HV_Trend:i phase_LV_Trend:i phase_HV_Ranging:i phase_LV_Ranging:i", "SELECT pair, ts, " + ", ".join(f"CAST(phase = '{p}' AS INTEGER) AS phase_{p}" for p in _PHASES) + " FROM enriched", "enriched")
def pf18_one_hot(spark, sf):
    """A column for each phase."""
    return X.one_hot(D.enriched(spark, sf), "phase", _PHASES)


@query("strategy:s category:s n:i", "SELECT strategy, CASE WHEN prefix(strategy, 'TF') THEN 'trend' WHEN prefix(strategy, 'MR') THEN 'reversion' WHEN prefix(strategy, 'PhaseAware') THEN 'aware' ELSE 'other' END AS category, count(*) AS n FROM (SELECT (['TF4','MR42','PhaseAware_TF4_MR42','none'])[c_custkey % 4 + 1] AS strategy FROM customer) GROUP BY 1, 2")
def pf19_strategy_category(spark, sf):
    """Kind of a strategy by its name."""
    names = F.array(*map(F.lit, ("TF4", "MR42", "PhaseAware_TF4_MR42", "none")))
    d = spark.read.parquet(f"{sf}/customer.parquet").select(F.element_at(names, (F.col("c_custkey") % 4 + 1).cast("int")).alias("strategy"))
    return d.groupBy("strategy").agg(F.count("*").alias("n")).withColumn("category", X.strategy_category(F.col("strategy")))


@query(
    "pair:s entry_time:t w12:f",
    "SELECT pair, entry_time, CASE WHEN ret_12b IS NOT NULL THEN least(greatest(ret_12b, lo), hi) END AS w12 FROM sentiment, (SELECT quantile_cont(ret_12b, 0.005) AS lo, quantile_cont(ret_12b, 0.995) AS hi FROM sentiment)", "sentiment",
)
def pf20_winsor_clip(spark, sf):
    """Returns kept within bounds; the bounds are one row."""
    from tidemark.operators.aggregates import winsor_bounds

    s = D.sentiment(spark, sf)
    clipped = F.when(F.col("ret_12b").isNotNull(), X.winsorised(F.col("ret_12b"), F.col("low"), F.col("high")))
    return s.join(F.broadcast(winsor_bounds(s, "ret_12b"))).withColumn("w12", clipped)


@query("week:s n:i", "SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM bars GROUP BY 1", "bars")
def pf21_iso_week(spark, sf):
    """Bars per ISO week."""
    return D.bars(spark, sf).groupBy(X.week_label(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


@query("pair:s is_jpy:b n:i", f"SELECT pair, suffix(pair, '-jpy') AS is_jpy, count(*) AS n FROM ({_NORM}) WHERE pair IS NOT NULL GROUP BY 1, 2")
def pf22_jpy_suffix(spark, sf):
    """Pairs quoted in yen."""
    d = _raw_pairs(spark, sf).select(X.normalised_pair(F.col("raw")).alias("pair")).dropna().groupBy("pair").agg(F.count("*").alias("n"))
    return d.withColumn("is_jpy", F.col("pair").endswith("-jpy"))


@query("run_id:s mode:s number:i family_token:s n:i", "SELECT run_id, regexp_extract(run_id, '_(dl|baseline)$', 1) AS mode, CAST(regexp_extract(run_id, '_([0-9]+)_', 1) AS BIGINT) AS number, split_part(run_id, '_', 1) AS family_token, count(*) AS n FROM runs GROUP BY run_id", "runs")
def pf23_names_parsed(spark, sf):
    """What run names say."""
    d = D.runs(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"))
    return d.withColumns({"mode": F.regexp_extract("run_id", "_(dl|baseline)$", 1), "number": F.regexp_extract("run_id", "_([0-9]+)_", 1).cast("long"), "family_token": F.split_part("run_id", F.lit("_"), F.lit(1))})


@query("generation:s variant:s n:i", "SELECT generation, CASE WHEN aware AND sentiment THEN 'A' WHEN aware THEN 'B' WHEN sentiment THEN 'C' ELSE 'D' END AS variant, count(DISTINCT run_id) AS n FROM runs GROUP BY 1, 2", "runs")
def pf25_variants(spark, sf):
    """Variant letter from a run's factors."""
    letter = F.when(F.col("aware") & F.col("sentiment"), "A").when(F.col("aware"), "B").when(F.col("sentiment"), "C").otherwise("D")
    return D.runs(spark, sf).groupBy("generation", letter.alias("variant")).agg(F.countDistinct("run_id").alias("n"))


_TEXTS = "SELECT c_custkey, (['1.5','','yes','abc','TRUE','0','-3'])[c_custkey % 7 + 1] AS x FROM customer"


@query(
    "c_custkey:i as_float:f as_int:i as_bool:b",
    f"SELECT c_custkey, TRY_CAST(nullif(x, '') AS DOUBLE) AS as_float, CAST(trunc(TRY_CAST(nullif(x, '') AS DOUBLE)) AS BIGINT) AS as_int, CASE WHEN trim(x) = '' THEN NULL ELSE lower(trim(x)) IN ('true', '1', 'yes') END AS as_bool FROM ({_TEXTS})",
)
def pf27_tolerant_casts(spark, sf):
    """Numbers and flags from text, NULL where there is none."""
    texts = F.array(*map(F.lit, ("1.5", "", "yes", "abc", "TRUE", "0", "-3")))
    d = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.element_at(texts, (F.col("c_custkey") % 7 + 1).cast("int")).alias("x"))
    return d.withColumns({"as_float": X.safe_float(F.col("x")), "as_int": X.safe_int(F.col("x")), "as_bool": X.safe_bool(F.col("x"))})


@query("pair:s experiment:s", """SELECT pair, 'exp_' || sha256('{"pair":"' || pair || '","version":"2"}')[1:16] AS experiment FROM bars GROUP BY pair""", "bars")
def pf28_hashed_ids(spark, sf):
    """Identifiers from canonical JSON."""
    canonical = F.to_json(F.struct(F.col("pair").alias("pair"), F.lit("2").alias("version")))
    return D.bars(spark, sf).select("pair").distinct().withColumn("experiment", X.hashed_id("exp_", canonical, 16))


@query("n:i hash:s")
def pf29_fingerprint(spark, sf):
    """Content hash of the bars, whatever their order."""
    return X.fingerprint(D.bars(spark, sf))


@query("pair:s ts:d cost:f size:f", "SELECT pair, ts, (0.5 * 1.2 + 0.3) * 0.0001 / close + 0.5 * 7 / 10000 AS cost, coalesce(CASE WHEN atr * 2 > 0 THEN 10000 * 0.01 / (atr * 2) END, 0) AS size FROM enriched", "enriched")
def pf30_31_cost_and_size(spark, sf):
    """Cost of a trade, and size at constant risk."""
    d = D.enriched(spark, sf)
    return d.withColumns({"cost": X.trade_cost(F.col("close"), F.lit(0.0001), 1.2, 0.3, 7.0, 10_000.0), "size": X.position_size(10_000.0, F.col("atr"), 0.01, F.lit(2.0))})


@query("pair:s fold:i overlap_state:s", "SELECT pair, fold, CASE WHEN overlap_pct <= 5 THEN 'missing' WHEN overlap_pct >= 95 THEN 'active' ELSE 'partial' END AS overlap_state FROM folds", "folds")
def pf32_overlap_state(spark, sf):
    """How far predictions cover a fold."""
    return D.folds(spark, sf).withColumn("overlap_state", X.overlap_state(F.col("overlap_pct")))


@query("run_id:s n:i", "SELECT run_id, count(*) AS n FROM runs WHERE generation = 'gen2' AND family IN ('jpy', 'eur') AND aware GROUP BY 1", "runs")
def pf33_cohort(spark, sf):
    """Runs of a cohort."""
    return D.runs(spark, sf).filter((F.col("generation") == "gen2") & F.col("family").isin("jpy", "eur") & F.col("aware")).groupBy("run_id").agg(F.count("*").alias("n"))


_THRESHOLD = "SELECT e.*, t FROM enriched e JOIN (SELECT pair, quantile_cont(atr_pct, 0.8) AS t FROM enriched GROUP BY pair) USING (pair)"


@query("pair:s ts:d spike:b near_spike:b", f"SELECT pair, ts, coalesce(atr_pct >= t, false) AS spike, coalesce(atr_pct >= 0.9 * t AND atr_pct < t, false) AS near_spike FROM ({_THRESHOLD})", "enriched")
def pf37_spikes(spark, sf):
    """Bars at or near the pair's volatility threshold."""
    e = D.enriched(spark, sf)
    t = e.groupBy("pair").agg(F.percentile("atr_pct", F.lit(0.8)).alias("t"))
    x = F.col("atr_pct")
    return e.join(t, "pair").withColumns({"spike": F.coalesce(x >= F.col("t"), F.lit(False)), "near_spike": F.coalesce((x >= 0.9 * F.col("t")) & (x < F.col("t")), F.lit(False))})


@query("run_id:s slug:s label:s", "SELECT DISTINCT run_id, regexp_replace(lower(run_id), '[^a-z0-9]+', '-', 'g') AS slug, generation || '_' || family || '_' || CASE WHEN aware THEN 'aware' ELSE 'blind' END AS label FROM runs WHERE generation IS NOT NULL", "runs")
def pf38_run_identity(spark, sf):
    """Names that identify a run."""
    d = D.runs(spark, sf).select("run_id", "generation", "family", "aware").distinct()
    label = F.concat_ws("_", "generation", "family", F.when(F.col("aware"), "aware").otherwise("blind"))
    return d.withColumns({"slug": F.regexp_replace(F.lower("run_id"), "[^a-z0-9]+", "-"), "label": label})


@query(
    "pair:s ts:d phase:s selected:s",
    "SELECT * FROM (SELECT pair, ts, phase, selected, phase IS DISTINCT FROM lag(phase) OVER w OR selected IS DISTINCT FROM lag(selected) OVER w OR row_number() OVER w = 1 AS c FROM timeline WINDOW w AS (PARTITION BY pair ORDER BY ts)) WHERE c", "timeline",
)
def pf40_changed_rows(spark, sf):
    """Rows where phase or selection changed."""
    return X.changed_rows(D.timeline(spark, sf), ["phase", "selected"], ["pair"], "ts")


@query("strategy_id:s n_folds:i n_trades:i", "SELECT strategy_id, n_folds, n_trades FROM evals", "evals")
def pf41_json_round_trip(spark, sf):
    """Records to JSON and back."""
    j = D.evaluations(spark, sf).select(F.to_json(F.struct("strategy_id", "n_folds", "n_trades")).alias("metadata"))
    return j.select(F.from_json("metadata", "strategy_id string, n_folds long, n_trades long").alias("r")).select("r.*")
