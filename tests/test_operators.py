"""Stateful operators and sources on tiny tables, against plain loops."""

import datetime as dt
import json

import pytest

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, pair="AB"):
    rows = [(pair, DAY + dt.timedelta(k), float(c), float(c) + 1, float(c) - 1, float(c), 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "pair string, ts date, open double, high double, low double, close double, volume double")


def slow_wilder(values, n):
    out, seen, y = [], [], None
    for x in values:
        if x is None:
            out.append(None)
            continue
        seen.append(x)
        y = sum(seen) / n if len(seen) == n else (y * (n - 1) + x) / n if len(seen) > n else None
        out.append(y)
    return out


def test_wilder_over_several_blocks(spark):
    from tidemark.operators import smoothing

    closes = [100 + (k * 37 % 11) for k in range(700)]
    df = bars(spark, closes)
    got = [r["y"] for r in smoothing.wilder(df, {"close": "y"}, 5).orderBy("ts").collect()]
    want = slow_wilder(closes, 5)
    assert got[:4] == [None] * 4
    assert got[4:] == pytest.approx(want[4:], rel=1e-9)


def test_labels_need_a_run_to_change(spark):
    from tidemark.operators import folds

    labels = list("AABAAABBBCAB")
    df = spark.createDataFrame([("p", k, x) for k, x in enumerate(labels)], "pair string, ts int, label string")
    got = "".join(r["smoothed"] for r in folds.smooth_labels(df, "label", 3).orderBy("ts").collect())
    # the first stretch that reaches three is the second run of A; single letters never take over
    assert got == "AAAAAABBBBBB"


def test_hourly_files(spark, tmp_path):
    from tidemark.sources.files import hourly_bars

    (tmp_path / "EURUSD60.csv").write_text("time_utc,open,high,low,close,tick_volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:00:00,1,2,0.5,1.7,11\nbad,1,1,1,1,1\n2024-01-01 01:00:00,x,1,1,1,1\n")
    got = hourly_bars(spark, str(tmp_path)).collect()
    assert [(r["pair"], r["close"], r["volume"]) for r in got] == [("eur-usd", 1.7, 11.0)]


def test_files_with_columns_in_any_order(spark, tmp_path):
    from tidemark.sources.files import daily_bars, hourly_bars

    (tmp_path / "EURUSD60.csv").write_text("time,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n")
    (tmp_path / "gbpusd_H1.csv").write_text("close, Low ,HIGH,Open,TIME_UTC,timestamp\n1.7,0.7,2.7,1.1,2024-01-01 03:00:00,\n1.8,0.8,2.8,1.2,,2024-01-01 05:00:00\n9,9,9,9,,2024-01-01 02:00:00,extra\n")
    (tmp_path / "EURUSD.csv").write_text("date,open,high,low,close,volume\n2024-01-01 00:00:00,9,9,9,9,9\n2024-01-02 00:00:00,9,9,9,9,9\n")
    got = sorted((r["pair"], str(r["ts"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in hourly_bars(spark, str(tmp_path)).collect())
    assert got == [
        ("eur-usd", "2024-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5, 10.0), ("gbp-usd", "2024-01-01 02:00:00", 9.0, 9.0, 9.0, 9.0, 0.0), ("gbp-usd", "2024-01-01 05:00:00", 1.2, 2.8, 0.8, 1.8, 0.0),
    ]
    assert [(r["pair"], r["close"]) for r in daily_bars(spark, str(tmp_path)).orderBy("pair").collect()] == [("eur-usd", 1.5), ("gbp-usd", 9.0)]


def test_result_files_with_mixed_headers(spark, tmp_path):
    from tidemark.sources import archive

    bodies = {
        "a/walkforward_results_per_fold__baseline.csv": "pair,Fold,Dynamic Sharpe,Baseline Sharpe,dl_overlap_active,dl_overlap_state\nP1,1.0,0.5,0.25,Yes,\"x, \"\"y\"\"\"\nP2,two,,bad,,\n",
        "b/walkforward_results_per_fold__dl_enabled.csv": "pair,sharpe_baseline,sharpe_dynamic,fold,dl_overlap_active\nP1,0.1,0.2,3,no\nP3,0.1\n",
        "c/walkforward_results_per_fold__baseline.csv": "name\nP\n",
        "a/selector_state_timeline.csv": "switch_event,timestamp,selector_confidence\n1,2024-01-01,0.5\n",
    }
    for path, body in bodies.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(body)
    rows = archive.result_tables(spark, str(tmp_path), "walkforward_results_per_fold").collect()
    got = sorted((r["run_id"], r["mode"], r["pair"] or "", r["fold"], r["sharpe_dynamic"], r["sharpe_baseline"], r["dl_overlap_active"], r["dl_overlap_state"]) for r in rows)
    assert got == [
        ("a", "baseline", "P1", 1, 0.5, 0.25, True, 'x, "y"'), ("a", "baseline", "P2", None, None, None, None, None), ("b", "dl_enabled", "P1", 3, 0.2, 0.1, False, None),
        ("b", "dl_enabled", "P3", None, None, 0.1, None, None), ("c", "baseline", "", None, None, None, None, None),
    ]
    problems = archive.result_problems(spark, str(tmp_path), "walkforward_results_per_fold", ["pair", "sharpe_dynamic"]).collect()
    assert sorted((r["file"].rsplit("/", 2)[1], r["problem"]) for r in problems) == [("b", "a row that does not fit the header"), ("c", "no column pair"), ("c", "no column sharpe_dynamic")]
    (line,) = archive.result_tables(spark, str(tmp_path), "selector_state_timeline").collect()
    assert (line["mode"], line["switch_event"], line["selector_confidence"], line["dl_active"]) == ("", True, 0.5, None)
    assert len(archive.FAMILIES) == 13 and all(archive.result_tables(spark, str(tmp_path), f).count() == 0 for f in ("results_ml", "results_per_pair"))


def test_archive_discovery(spark, tmp_path):
    from tidemark.sources import archive

    for name, files in (("a", ["run_manifest.json", "walkforward__baseline.csv"]), ("a/sub", ["x.csv"]), ("b", ["run_manifest_1.json", "run_manifest_2.json"]), ("c", ["results_ml_x.csv", archive.LEGACY_MARKER]), ("d", ["results_ml.csv"]), ("e", ["y.csv", archive.LEGACY_MARKER])):
        (tmp_path / name).mkdir(exist_ok=True)
        for f in files:
            body = json.dumps({"run": {"id": "r1", "seed": 7}, "experiment": {"generation": "g2", "factors": {"family": "jpy", "aware": "true"}}}) if f.endswith("json") else "pair,Dynamic Sharpe\nP1,0.5\nP2,\n"
            (tmp_path / name / f).write_text(body)
    kinds = {r["folder"].rsplit("/", 1)[1]: r["kind"] for r in archive.discover(spark, str(tmp_path)).collect()}
    assert kinds == {"a": "run", "b": "several manifests", "c": "legacy", "d": "other", "e": "other"}
    rows = archive.result_tables(spark, str(tmp_path), "walkforward", {"pair": "string", "sharpe_dynamic": "double", "absent": "double"}).collect()
    assert sorted((r["run_id"], r["mode"], r["pair"], r["sharpe_dynamic"], r["absent"]) for r in rows if r["pair"] == "P1") == [("a", "baseline", "P1", 0.5, None)]


def test_as_of_takes_the_last_row_before(spark):
    from tidemark.operators.joins import as_of

    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 10, 1.0)], "k string, u int, v double")
    got = {(r["k"], r["t"]): (r["v"], r["v_time"]) for r in as_of(left, right, "v", ["k"], "t", "u").collect()}
    assert got == {("a", 5): (50.0, 5), ("a", 1): (None, None), ("b", 9): (None, None)}


def test_recommendations_put_what_is_no_number_last(spark):
    from tidemark.operators.ranking import ranked_recommendations

    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", float("nan"), 9.0), ("c", float("inf"), 9.0), ("d", None, 9.0), ("e", 1.0, 2.0)], "strategy_id string, expected_sharpe double, expected_return double")
    assert [r["strategy_id"] for r in ranked_recommendations(df).orderBy("rank").collect()][:2] == ["e", "a"]
    with pytest.raises(ValueError):
        ranked_recommendations(df, 0)


def test_runs_take_all_customers(spark, tmp_path):
    from tidemark.plans import derive

    keys = [1, 150_000, 150_001, 1_500_000]
    spark.createDataFrame([(k, k % 25, 1.0) for k in keys], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(r["row_id"] for r in derive.runs(spark, str(tmp_path)).collect()) == keys


def test_positions_by_month_are_those_of_the_whole_pair(spark):
    from tidemark.operators import windows as W

    df = bars(spark, range(100)).union(bars(spark, range(40), "CD")).union(bars(spark, [1.0], "EF").withColumn("ts", W.F.lit(None).cast("date")))
    found = {(r.pair, r.ts): r.pos for r in W.position_by_month(df).collect()}
    assert found == {(r.pair, r.ts): r.pos for r in W.with_position(df).collect()} and len(found) == 141
    assert W.position_by_month(df.limit(0)).count() == 0
