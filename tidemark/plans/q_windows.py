"""Queries: windowed analytics (W) and signals (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import ledger as L
from tidemark.operators import signals as S
from tidemark.operators import windows as W
from tidemark.plans import derive as D
from tidemark.plans.core import query

_W = "WINDOW w AS (PARTITION BY pair ORDER BY ts)"


def _frame(n: int, until: int = 0) -> str:
    return f"(PARTITION BY pair ORDER BY ts ROWS BETWEEN {n - 1 - until} PRECEDING AND {-until if until < 0 else 0} {'PRECEDING' if until < 0 else 'FOLLOWING'})".replace("0 FOLLOWING", "CURRENT ROW")


def _full(agg: str, of: str, n: int, until: int = 0) -> str:
    f = _frame(n, until)
    return f"CASE WHEN count({of}) OVER {f} = {n} THEN {agg} OVER {f} END"


@query("pair:s ts:d returns:f log_returns:f", "SELECT * FROM rets", "rets")
def w01_returns(spark, sf):
    """Simple and logarithmic returns."""
    return W.returns(D.bars(spark, sf))


@query(
    "pair:s ts:d next_return:f next_direction:f next_direction_binary:i",
    "SELECT *, sign(next_return) AS next_direction, CASE WHEN next_return > 0 THEN 1 ELSE 0 END AS next_direction_binary FROM rets WHERE returns IS NOT NULL AND next_return IS NOT NULL", "rets",
)
def w02_targets(spark, sf):
    """Targets from the next return."""
    return W.targets(D.bars(spark, sf))


@query(
    "pair:s ts:d returns_lag_1:f returns_lag_5:f returns_lag_10:f adx_lag_2:f adx_lag_3:f",
    f"SELECT pair, ts, lag(returns) OVER w AS returns_lag_1, lag(returns, 5) OVER w AS returns_lag_5, lag(returns, 10) OVER w AS returns_lag_10, lag(adx, 2) OVER w AS adx_lag_2, lag(adx, 3) OVER w AS adx_lag_3 FROM enriched {_W}", "enriched",
)
def w03_lags(spark, sf):
    """Lags of returns and ADX."""
    return W.lags(W.lags(D.enriched(spark, sf), "returns"), "adx")


def _rolling_sql(stat: str, agg: str) -> str:
    return ", ".join(f"{_full(agg, 'returns', n)} AS returns_{stat}_{n}" for n in (5, 10, 20))


@query("pair:s ts:d returns_mean_5:f returns_mean_10:f returns_mean_20:f", f"SELECT pair, ts, {_rolling_sql('mean', 'avg(returns)')} FROM rets", "rets")
def w04_rolling_mean(spark, sf):
    """Rolling means."""
    return W.rolling(W.returns(D.bars(spark, sf)), "returns")


@query("pair:s ts:d returns_std_5:f returns_std_10:f returns_std_20:f", f"SELECT pair, ts, {_rolling_sql('std', 'stddev_samp(returns)')} FROM rets", "rets")
def w05_rolling_std(spark, sf):
    """Rolling sample deviations."""
    return W.rolling(W.returns(D.bars(spark, sf)), "returns")


@query("pair:s ts:d returns_skew_5:f returns_skew_10:f returns_skew_20:f", f"SELECT pair, ts, {_rolling_sql('skew', 'skewness(returns)')} FROM rets", "rets")
def w06_rolling_skew(spark, sf):
    """Rolling bias-corrected skewness."""
    return W.rolling(W.returns(D.bars(spark, sf)), "returns")


@query("pair:s ts:d di_spread:f di_ratio:f", "SELECT pair, ts, plus_di - minus_di AS di_spread, plus_di / nullif(minus_di, 0) AS di_ratio FROM enriched", "enriched")
def w07_di_spread_ratio(spark, sf):
    """Spread and ratio of the directional indicators."""
    return D.enriched(spark, sf).withColumns({"di_spread": F.col("plus_di") - F.col("minus_di"), "di_ratio": F.col("plus_di") / F.nullif("minus_di", F.lit(0.0))})


@query("pair:s ts:d atr_pct:f high_vol:b", "SELECT * FROM enriched", "enriched")
def w08_high_volatility(spark, sf):
    """Volatility against its rolling median."""
    return D.enriched(spark, sf)


@query("pair:s ts:d sma9:f sma200:f", f"SELECT pair, ts, {_full('avg(close)', 'close', 9)} AS sma9, {_full('avg(close)', 'close', 200)} AS sma200 FROM bars", "bars")
def w09_sma(spark, sf):
    """Simple moving averages."""
    return D.bars(spark, sf).withColumns({"sma9": W.sma("close", 9), "sma200": W.sma("close", 200)})


_LWMA = " + ".join(f"{w} * lag(close, {40 - w}) OVER w" for w in range(1, 41))


@query("pair:s ts:d lwma40:f", f"SELECT pair, ts, ({_LWMA}) / 820 AS lwma40 FROM bars {_W}", "bars")
def w10_lwma(spark, sf):
    """Linearly weighted moving average."""
    return D.bars(spark, sf).withColumn("lwma40", W.lwma("close", 40))


_BANDS = f"SELECT *, mid + sd AS upper, mid - sd AS lower FROM (SELECT *, ({_LWMA}) / 820 AS mid, {_full('stddev_samp(close)', 'close', 20)} AS sd FROM enriched {_W})"


@query("pair:s ts:d mid:f upper:f lower:f", _BANDS, "enriched")
def w11_weighted_bands(spark, sf):
    """Bands around the weighted average."""
    return W.weighted_bands(D.enriched(spark, sf))


def _boll(k: int) -> str:
    return f"SELECT *, mid + {k} * sd AS upper, mid - {k} * sd AS lower FROM (SELECT *, {_full('avg(close)', 'close', 20)} AS mid, {_full('stddev_pop(close)', 'close', 20)} AS sd FROM enriched)"


@query("pair:s ts:d mid:f upper:f lower:f", _boll(2), "enriched")
def w12_bollinger(spark, sf):
    """Bollinger bands."""
    return W.bollinger(D.enriched(spark, sf), 20, 2.0)


_CHANNEL = f"SELECT *, {_full('max(close)', 'close', 20, -1)} AS channel_high, {_full('min(close)', 'close', 20, -1)} AS channel_low FROM enriched"


@query("pair:s ts:d channel_high:f channel_low:f", _CHANNEL, "enriched")
def w13_donchian(spark, sf):
    """Channel of the closes before."""
    return W.donchian(D.enriched(spark, sf), 20)


def _k(n: int) -> str:
    lo, hi = _full("min(low)", "low", n), _full("max(high)", "high", n)
    return f"(close - {lo}) / nullif({hi} - {lo}, 0) * 100"


@query("pair:s ts:d k5:f k2:f", f"SELECT pair, ts, {_k(5)} AS k5, {_k(2)} AS k2 FROM bars", "bars")
def w14_stochastic(spark, sf):
    """Stochastic oscillator."""
    return D.bars(spark, sf).withColumns({"k5": W.stochastic(5), "k2": W.stochastic(2)})


@query("pair:s ts:d tr:f atr:f plus_di:f minus_di:f adx:f rsi:f", "SELECT * FROM enriched", "enriched")
def w16_range_indicators(spark, sf):
    """True range and indicators over plain frames."""
    return D.enriched(spark, sf)


@query(
    "pair:s ts:d filled:f",
    "SELECT pair, ts, last_value(CASE WHEN volume > 300 THEN atr_pct END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled FROM enriched", "enriched",
)
def w19_forward_fill(spark, sf):
    """Last known value."""
    return D.enriched(spark, sf).withColumn("gappy", F.when(F.col("volume") > 300, F.col("atr_pct"))).withColumn("filled", W.forward_fill("gappy"))


@query(
    "pair:s ts:d held:i",
    "SELECT pair, ts, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS held FROM (SELECT *, CASE WHEN adx > 40 THEN 1 WHEN adx < 15 THEN 0 END AS e FROM enriched)", "enriched",
)
def w20_hold_event(spark, sf):
    """Position held from the last event."""
    return D.enriched(spark, sf).withColumn("e", F.when(F.col("adx") > 40, 1).when(F.col("adx") < 15, 0)).withColumn("held", W.hold(F.col("e")))


@query(
    "pair:s ts:d up:b down:b",
    f"SELECT pair, ts, rsi > 50 AND lag(rsi) OVER w <= 50 AS up, rsi < 50 AND lag(rsi) OVER w >= 50 AS down FROM enriched {_W}", "enriched",
)
def w21_crossover(spark, sf):
    """Crossings of a level."""
    half = F.lit(50.0)
    return D.enriched(spark, sf).withColumns({"up": W.crosses_above(F.col("rsi"), half), "down": W.crosses_below(F.col("rsi"), half)})


@query(
    "pair:s ts:d peak:f drawdown:f", "SELECT pair, ts, m AS peak, close / m - 1 AS drawdown FROM (SELECT *, max(close) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS m FROM bars)", "bars"
)
def w22_drawdown(spark, sf):
    """Fall from the highest close so far."""
    return W.drawdown(D.bars(spark, sf), "close")


@query("pair:s ts:d norm:f", f"SELECT pair, ts, close / first_value(close) OVER w * 100 AS norm FROM bars {_W}", "bars")
def w23_normalised(spark, sf):
    """Close as a percentage of the first."""
    return D.bars(spark, sf).withColumn("norm", W.normalised("close"))


@query("pair:s ts:d gap_days:i", f"SELECT pair, ts, date_diff('day', lag(ts) OVER w, ts) AS gap_days FROM bars {_W}", "bars")
def w24_gap_days(spark, sf):
    """Days since the bar before."""
    return W.gap_days(D.bars(spark, sf))


_PHASE_ISLANDS = """SELECT pair, sum(c) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island, ts, phase FROM (
    SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY pair ORDER BY ts) THEN 1 ELSE 0 END AS c FROM enriched)"""


@query(
    "pair:s transitions:i mean_length:f median_length:f min_length:i max_length:i",
    f"SELECT pair, count(*) - 1 AS transitions, avg(n) AS mean_length, quantile_cont(n, 0.5) AS median_length, min(n) AS min_length, max(n) AS max_length FROM (SELECT pair, island, count(*) AS n FROM ({_PHASE_ISLANDS}) GROUP BY 1, 2) GROUP BY 1", "enriched",
)
def w25_island_lengths(spark, sf):
    """Lengths of stretches of one phase."""
    return W.island_lengths(D.enriched(spark, sf), "phase")


@query(
    "pair:s year:i transitions:i mean_length:f median_length:f min_length:i max_length:i",
    f"SELECT pair, year(b) AS year, count(*) - 1 AS transitions, avg(n) AS mean_length, quantile_cont(n, 0.5) AS median_length, min(n) AS min_length, max(n) AS max_length FROM (SELECT pair, island, year(ts) AS y, count(*) AS n, min(ts) AS b FROM ({_PHASE_ISLANDS}) GROUP BY 1, 2, 3) GROUP BY 1, 2", "enriched",
)
def w25_island_lengths_by_year(spark, sf):
    """Lengths of stretches of one phase inside each year."""
    return W.island_lengths(D.enriched(spark, sf).withColumn("year", F.year("ts")), "phase", ["year"])


@query("pair:s n_switches:i", f"SELECT pair, sum(s) AS n_switches FROM (SELECT pair, CASE WHEN selected <> lag(selected) OVER w THEN 1 ELSE 0 END AS s FROM timeline {_W}) GROUP BY pair", "timeline")
def w26_switch_count(spark, sf):
    """Changes of the selected type."""
    t = D.timeline(spark, sf).withColumn("s", W.switched("selected"))
    return t.groupBy("pair").agg(F.sum(F.col("s").cast("long")).alias("n_switches"))


@query(
    "pair:s ts:d fwd:f",
    f"SELECT * FROM (SELECT pair, ts, lead(close, 20) OVER w / close - 1 AS fwd, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY pair) AS n FROM bars {_W}) WHERE pos <= n - 22", "bars",
)
def w27_forward_return(spark, sf):
    """Return over the next 20 bars, of positions that the labels cover."""
    from pyspark.sql.window import Window

    d = W.with_position(D.bars(spark, sf)).withColumn("fwd", W.forward_return("close", 20)).withColumn("n", F.count("*").over(Window.partitionBy("pair")))
    return d.filter("pos <= n - 22")


@query("pair:s ts:d recent:f", "SELECT pair, ts, avg(returns) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM rets", "rets")
def w28_previous_mean(spark, sf):
    """Mean of up to five returns before."""
    return W.returns(D.bars(spark, sf)).withColumn("recent", W.previous_mean("returns"))


@query("pair:s ts:d executed:i", "SELECT pair, ts, executed FROM exec", "exec")
def w29_executed_signal(spark, sf):
    """Signal of the bar before."""
    return L.executed(S.sma_cross(D.enriched(spark, sf)))


_TRANS = f"SELECT *, CASE WHEN lag(dl_active) OVER w IS NULL THEN 'first' WHEN dl_active AND NOT lag(dl_active) OVER w THEN 'enter' WHEN NOT dl_active AND lag(dl_active) OVER w THEN 'exit' ELSE 'steady' END AS transition FROM timeline {_W}"


@query("pair:s ts:d transition:s", _TRANS, "timeline")
def w30_state_transitions(spark, sf):
    """Entering and leaving the active state."""
    return W.state_transitions(D.timeline(spark, sf), "dl_active")


@query(
    "pair:s fold:i active:b", "SELECT pair, fold, row_number() OVER (PARTITION BY pair ORDER BY fold DESC) <= round_even(count(*) OVER (PARTITION BY pair) * 0.35, 0) AS active FROM folds", "folds"
)
def w31_last_share(spark, sf):
    """The last folds of a pair as active."""
    return W.last_share_active(D.folds(spark, sf).withColumn("ts", F.col("fold")), 0.35)


@query(
    "pair:s ts:d window_no:i",
    f"""SELECT pair, ts, win AS window_no FROM (SELECT *, min(num) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS win FROM (
        SELECT *, CASE WHEN transition IN ('enter', 'exit') THEN sum(CASE WHEN transition IN ('enter', 'exit') THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS num FROM ({_TRANS}))) WHERE win IS NOT NULL""", "timeline",
)
def w32_around_transitions(spark, sf):
    """Rows near a transition."""
    return W.around_transitions(D.timeline(spark, sf), "dl_active", 3).withColumnRenamed("window", "window_no")


@query("pair:s ts:d pos:i", f"SELECT pair, ts, row_number() OVER w - 1 AS pos FROM bars {_W}", "bars")
def w33_position(spark, sf):
    """Number of the bar within its pair."""
    return W.with_position(D.bars(spark, sf))


@query(
    "pair:s day:d flips:i",
    """SELECT pair, day, sum(CASE WHEN s <> b THEN 1 ELSE 0 END) AS flips FROM (SELECT pair, day, s, lag(s) OVER (PARTITION BY pair, day ORDER BY timestamp) AS b FROM (
        SELECT pair, CAST(timestamp AS DATE) AS day, timestamp, sign(signal_strength) AS s FROM clean_cube WHERE signal_strength <> 0)) GROUP BY 1, 2""", "clean_cube",
)
def w34_sign_flips(spark, sf):
    """Changes of sign of the prediction within a day."""
    c = D.clean_cube(spark, sf).withColumn("day", F.to_date("timestamp"))
    return W.sign_flips(c, "signal_strength", ["pair", "day"], "timestamp")


@query("pair:s ts:d target:i", f"SELECT pair, ts, CASE lead(phase) OVER w WHEN 'HV_Trend' THEN 0 WHEN 'LV_Trend' THEN 1 WHEN 'HV_Ranging' THEN 2 WHEN 'LV_Ranging' THEN 3 END AS target FROM enriched {_W}", "enriched")
def w38_next_phase(spark, sf):
    """Class of the next bar's phase."""
    codes = F.create_map(*[F.lit(x) for kv in (("HV_Trend", 0), ("LV_Trend", 1), ("HV_Ranging", 2), ("LV_Ranging", 3)) for x in kv])
    return D.enriched(spark, sf).withColumn("target", F.element_at(codes, F.lead("phase").over(W.by_time())))


@query("pair:s ts:d returns_mean_20:f returns_std_20:f", f"SELECT pair, ts, {_rolling_sql('mean', 'avg(returns)')}, {_rolling_sql('std', 'stddev_samp(returns)')} FROM rets", "rets")
def w_blocked_rolling(spark, sf):
    """The rolling statistics again, with each pair cut into blocks of 500 bars that run as tasks of their own."""
    placed = W.position_by_month(D.bars(spark, sf))
    # the frame of 20 returns needs 20 bars before the current one
    return W.in_blocks(placed, 20, 500, lambda d: W.rolling(W.returns(d), "returns"))


# signals

_HOLD = "coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)"


def _above(a: str, b: str) -> str:
    return f"({a} > {b} AND lag({a}) OVER w <= lag({b}) OVER w)"


def _below(a: str, b: str) -> str:
    return f"({a} < {b} AND lag({a}) OVER w >= lag({b}) OVER w)"


def _sql(source: str, short: str, long: str, out: str | None = None) -> str:
    third = f"WHEN {out} THEN 0 " if out else ""
    return f"SELECT *, {_HOLD} AS signal FROM (SELECT *, CASE WHEN {short} THEN -1 WHEN {long} THEN 1 {third}END AS ev FROM ({source}) {_W})"


_RSI = "SELECT *, 50.0 AS h, 25.0 AS r25, 75.0 AS r75, 30.0 AS r30, 70.0 AS r70, 35.0 AS r35, 65.0 AS r65, 45.0 AS r45, 55.0 AS r55 FROM enriched"
SIGNAL_SQL = {
    "TF1": _sql(_BANDS, _below("close", "lower"), _above("close", "upper"), f"{_below('close', 'upper')} OR {_above('close', 'lower')}"),
    "TF2": _sql(_CHANNEL, "close < channel_low", "close > channel_high"),
    "TF3": "SELECT * FROM smac",
    "TF4": _sql(f"SELECT *, ({_LWMA}) / 820 AS mean, {_k(5)} AS k FROM enriched {_W}", "mean - lag(mean) OVER w < 0 AND k > 80", "mean - lag(mean) OVER w > 0 AND k < 20", "k > 80 OR k < 20"),
    "TF5": _sql(_boll(1), _below("close", "lower"), _above("close", "upper"), f"{_below('close', 'mid')} OR {_above('close', 'mid')}"),
    "MR1": _sql(_BANDS, _above("close", "upper"), _below("close", "lower"), f"{_below('close', 'mid')} OR {_above('close', 'mid')}"),
    "MR2": _sql(f"SELECT *, {_k(2)} AS k, 50.0 AS h FROM enriched", "k > 85 AND k < lag(k) OVER w", "k < 15 AND k > lag(k) OVER w", f"{_above('k', 'h')} OR {_below('k', 'h')}"),
    "MR3": _sql(_RSI, _below("rsi", "r75"), _above("rsi", "r25")),
    "MR32": _sql(_RSI, f"{_below('rsi', 'r65')} AND phase <> 'HV_Trend' AND adx < 35", f"{_above('rsi', 'r35')} AND phase <> 'HV_Trend' AND adx < 35", f"{_above('rsi', 'r55')} OR {_below('rsi', 'r45')}"),
    "MR42": _sql(_boll(2), f"{_below('close', 'upper')} AND adx < 20", f"{_above('close', 'lower')} AND adx < 20"),
    "MR5": _sql(_boll(2), _below("close", "upper"), _above("close", "lower")),
}
_NAMES = {"TF1": "g01", "TF2": "g02", "TF3": "g03", "TF4": "g04", "TF5": "g05", "MR1": "g06", "MR2": "g07", "MR3": "g08", "MR32": "g09", "MR42": "g10", "MR5": "g11"}


def _strategy(key: str):
    def run(spark, sf):
        return S.STRATEGIES[key](D.enriched(spark, sf))

    run.__doc__ = S.STRATEGIES[key].__doc__
    stops = {"MR1": (0.02, 0.02), "MR2": (0.02, 0.02), "MR3": (0.01, 0.03), "MR32": (0.025, 0.0), "MR42": (0.025, 0.0125), "MR5": (0.02, 0.02)}.get(key, (0.0, 0.0))
    sql = f"SELECT pair, ts, signal, {stops[0]} AS sl_pct, {stops[1]} AS tp_pct FROM ({SIGNAL_SQL[key]})"
    query("pair:s ts:d signal:i sl_pct:f tp_pct:f", sql, "smac", name=f"{_NAMES[key]}_{key.lower()}")(run)


for _key in SIGNAL_SQL:
    _strategy(_key)


@query("pair:s ts:d signal:i", _sql("SELECT * FROM enriched", f"{_below('plus_di', 'minus_di')} AND adx > 25", f"{_above('plus_di', 'minus_di')} AND adx > 25", "adx < 15"), "enriched")
def g12_di_cross(spark, sf):
    """Cross of the directional indicators."""
    return S.di_cross(D.enriched(spark, sf))


@query("pair:s ts:d signal:i", _sql(_RSI, _above("rsi", "r70"), _below("rsi", "r30"), f"{_above('rsi', 'h')} OR {_below('rsi', 'h')}"), "enriched")
def g13_rsi_plain(spark, sf):
    """RSI levels."""
    return S.rsi_plain(D.enriched(spark, sf))


_SIZES = {"HV_Trend": 0.5, "LV_Trend": 1.0, "HV_Ranging": 0.5, "LV_Ranging": 0.75}
_TWO = f"SELECT e.*, a.signal AS tf, b.signal AS mr FROM enriched e JOIN ({SIGNAL_SQL['TF3']}) a USING (pair, ts) JOIN ({SIGNAL_SQL['MR5']}) b USING (pair, ts)"


@query(
    "pair:s ts:d signal:f",
    f"SELECT pair, ts, CASE WHEN trending THEN tf ELSE mr END * CASE phase WHEN 'HV_Trend' THEN 0.5 WHEN 'LV_Trend' THEN 1.0 WHEN 'HV_Ranging' THEN 0.5 ELSE 0.75 END AS signal FROM ({_TWO})", "smac",
)
def g14_phase_router(spark, sf):
    """Signal routed by phase."""
    both = S.all_signals(D.enriched(spark, sf), ["TF3", "MR5"])
    return S.phase_router(both, "TF3", "MR5", _SIZES)


@query(
    "strategy_id:s pair:s n_active:i mean_ret:f",
    f"SELECT strategy_id, pair, sum(CASE WHEN signal <> 0 THEN 1 ELSE 0 END) AS n_active, avg(signal * next_return) AS mean_ret FROM (SELECT pair, 'TF3' AS strategy_id, tf AS signal, next_return FROM ({_TWO}) UNION ALL SELECT pair, 'MR5', mr, next_return FROM ({_TWO})) GROUP BY 1, 2", "smac",
)
def g15_all_strategies(spark, sf):
    """Strategies side by side, then long, then summarised."""
    long = S.long_form(S.all_signals(D.enriched(spark, sf), ["TF3", "MR5"]), ["TF3", "MR5"])
    return long.groupBy("strategy_id", "pair").agg(F.sum((F.col("signal") != 0).cast("long")).alias("n_active"), F.avg(F.col("signal") * F.col("next_return")).alias("mean_ret"))


@query(
    "pair:s n_trades:i win_rate:f profit_factor:f avg_pnl:f avg_days:f gross_profit:f gross_loss:f",
    """SELECT pair, count(*) AS n_trades, avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, CASE WHEN sum(CASE WHEN pnl_pct < 0 THEN -pnl_pct ELSE 0 END) > 0 THEN sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0 END) / sum(CASE WHEN pnl_pct < 0 THEN -pnl_pct ELSE 0 END) ELSE 0 END AS profit_factor,
        avg(pnl_pct) AS avg_pnl, avg(date_diff('day', entry_date, exit_date)) AS avg_days, sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0 END) AS gross_profit, sum(CASE WHEN pnl_pct < 0 THEN -pnl_pct ELSE 0 END) AS gross_loss FROM trades GROUP BY pair""", "trades",
)
def flagship_trade_metrics(spark, sf):
    """From line items to daily bars, a crossing of averages, its trades, and their metrics per pair."""
    return A.trade_metrics(D.trades(spark, sf), ["pair"])


@query("pair:s direction:i phase:s entry_date:d exit_date:d entry_price:f exit_price:f pnl_pct:f bars:i", "SELECT * FROM trades", "trades")
def s03_island_trades(spark, sf):
    """Trades without stops."""
    return D.trades(spark, sf)


@query(
    "pair:s total_return:f sharpe:f max_drawdown:f",
    """SELECT pair, arg_max(eq, ts) - 1 AS total_return, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, min(eq / greatest(pk, 1) - 1) AS max_drawdown FROM (
        SELECT *, max(eq) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS eq FROM (SELECT *, CASE WHEN returns IS NOT NULL THEN greatest(-0.5, executed * returns * 0.01) END AS r FROM exec))) GROUP BY pair""", "exec",
)
def a06_equity_metrics(spark, sf):
    """Return, Sharpe ratio and drawdown of a compounded curve."""
    x = L.executed(S.sma_cross(D.enriched(spark, sf))).withColumn("ret", F.when(F.col("returns").isNotNull(), F.greatest(F.lit(-0.5), F.col("executed") * F.col("returns") * 0.01)))
    return A.equity_metrics(x, ["pair"])
