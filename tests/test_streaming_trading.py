"""The stream of bars against the batch operators: several micro-batches, a restart, and trades that a timer ends."""

import datetime as dt
import random

from pyspark.sql import functions as F

SCHEMA = "pair string, ts timestamp, high double, low double, close double, phase string, p_trend double, p_reversion double, spike boolean, usd_quote boolean, trending boolean, trend_signal double, reversion_signal double, trend_sl double, trend_tp double, reversion_sl double, reversion_tp double"
FIRST = dt.datetime(2020, 1, 1)


def bars(pair, n, seed):
    rng, close, out = random.Random(seed), 100.0, []
    for k in range(n):
        close *= 1 + rng.uniform(-0.03, 0.03)
        out.append((pair, FIRST + dt.timedelta(k), close * 1.02, close * 0.98, close, rng.choice("xy"), rng.choice([0.2, 0.6, 0.8, None]), rng.choice([0.1, 0.5, 0.7]), rng.random() < 0.1, pair == "AB", rng.random() < 0.5,
                    float(rng.choice([-1, 0, 1])), float(rng.choice([-1, 1])), 0.03, 0.05, 0.02, 0.0))
    return out


def run(spark, folder, **how):
    from tidemark.streaming import trading

    stream = trading.traded(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), **how)
    with trading.with_timers(spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination()
    return [r.asDict() for r in spark.read.parquet(f"{folder}/out").collect()]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_stream_equals_batch_over_batches_and_a_restart(spark, tmp_path):
    from tidemark.operators import ledger as L
    from tidemark.operators import router as R

    rows = sorted(bars("AB", 60, 1) + bars("CD", 60, 2), key=lambda r: r[1])
    jumbled = sorted(rows, key=lambda r: r[1] + dt.timedelta(random.Random(str(r[1]) + r[0]).choice([0, 0, 2])))  # up to two days late
    put(spark, tmp_path, jumbled[:40])
    put(spark, tmp_path, jumbled[40:75])
    before = run(spark, tmp_path)
    put(spark, tmp_path, jumbled[75:])
    got = run(spark, tmp_path)
    assert 0 < len(before) < len(got)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_date("ts"))
    routed = R.route(df, {"p": R.Policy()}).cache()
    last = max(r["ts"] for r in got if r["kind"] == "route")
    columns = ("pair", "ts", "selected", "switched", "held", "rule", "signal", "sl_pct", "tp_pct")
    want = sorted(tuple(r[c] for c in columns) for r in routed.collect() if r["ts"] <= last)
    assert sorted(tuple(r[c] for c in columns) for r in got if r["kind"] == "route") == want and len(want) > 110
    trades = L.ledger_trades(routed.join(df.select("pair", "ts", "high", "low", "close", "phase"), ["pair", "ts"]), keys=["pair", "policy"]).collect()
    columns = ("pair", "entry_date", "direction", "entry_price", "exit_price", "size", "pnl_pct", "exit_reason", "phase")
    want = sorted((*(r[c] for c in columns), r["exit_date"]) for r in trades if r["exit_date"] <= last and r["exit_reason"] != "end")
    assert sorted((*(r[c] for c in columns), r["ts"]) for r in got if r["kind"] == "trade") == want and len(want) > 20


def test_a_timer_ends_a_trade_without_bars(spark, tmp_path):
    # one pair is long and then silent; the other one's bars move the watermark on
    def calm(pair, day, signal):
        return (pair, FIRST + dt.timedelta(day), 101.0, 99.0, 100.0, "x", 0.0, 0.0, False, True, True, signal, 0.0, 0.0, 0.0, 0.0, 0.0)

    put(spark, tmp_path, [calm("AB", d, 1.0) for d in range(4)] + [calm("CD", d, 0.0) for d in range(4)])
    put(spark, tmp_path, [calm("CD", 30, 0.0)])
    put(spark, tmp_path, [calm("CD", 31, 0.0)])
    trades = [r for r in run(spark, tmp_path, most_days=10) if r["kind"] == "trade"]
    assert [(r["pair"], r["entry_date"], r["ts"], r["exit_reason"]) for r in trades] == [("AB", dt.date(2020, 1, 2), dt.date(2020, 1, 12), "max_hold")]
