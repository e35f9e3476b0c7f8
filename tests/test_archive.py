"""Archives as plain files: what is opened, what is said of them, and logs over many blocks."""

import json
import os

import pytest

SF = "/root/testdata/sf0.001"


def files_read(df) -> int:
    """How many files the scans of a plan opened."""
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        n = p.metrics().get("numFiles")
        seen += n.get().value() if n.isDefined() and "Scan" in p.nodeName() else 0
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return seen


def test_a_family_opens_only_its_files(spark, tmp_path):
    from tidemark.sources.delimited import lines_of

    for name in ("results_ml__baseline.csv", "results_summary__baseline.csv", "run_manifest.json", "log.txt"):
        (tmp_path / name).write_text("pair,accuracy\nP1,0.5\n")
    lines = lines_of(spark, str(tmp_path), r"^results_ml__[a-z_]+\.csv$")
    assert files_read(lines) == 1 and lines.count() == 2
    assert lines_of(spark, str(tmp_path), "^absent$").count() == 0


def test_bad_files_are_rows_of_the_problem_table(spark, tmp_path):
    from tidemark.sources import archive

    bad = {"results_ml__a.csv": "model,accuracy,std\nm,0.5,0.1\nm,x,\n", "results_ml__b.csv": "name,accuracy\nm,1\n", "results_ml__c.csv": "model,accuracy,accuracy\nm,1,2\nm,3\n", "results_ml__d.csv": "", "results_summary__a.csv": "pair,strategy\nP1,TF1\n"}
    for name, body in bad.items():
        (tmp_path / name).write_text(body)
    tables, problems = archive.all_results(spark, str(tmp_path))
    found = sorted((r["family"], r["file"].rsplit("/", 1)[1], r["problem"]) for r in problems.filter("family = 'results_ml'").collect())
    assert found == [
        ("results_ml", "results_ml__a.csv", "no number in accuracy"), ("results_ml", "results_ml__b.csv", "no column model"),
        ("results_ml", "results_ml__c.csv", "a column name twice"), ("results_ml", "results_ml__c.csv", "a row that does not fit the header"),
    ]
    rows = sorted((r["mode"], r["model"] or "", r["accuracy"] or 0.0) for r in tables["results_ml"].collect())
    assert rows == [("a", "m", 0.0), ("a", "m", 0.5), ("b", "", 1.0), ("c", "m", 1.0), ("c", "m", 3.0)]
    assert [(r["pair"], r["strategy"]) for r in tables["results_summary"].collect()] == [("P1", "TF1")]


def test_manifests_of_odd_kinds(spark, tmp_path):
    from tidemark.sources.manifests import manifests

    odd = {
        "x_aware_1": {"experiment": {"generation": "gen1", "variant": "A", "factors": {"missing_indicators_enabled": False, "dl_enabled": None, "sentiment_enabled": "no"}}},
        "both_aware-1_blind": {"experiment": {"factors": {"missing_indicators_enabled": True}}, "run": "none"},
        "list": {"experiment": [1], "experiment_surface": {"sentiment_surface": False, "surface_semantics_version": "x"}},
        "array": [1, 2], "null": None,
        "boolean": {"dl": {"dl_enabled": False}, "experiment_surface": {"surface_source": " ", "sentiment_surface": True, "surface_semantics_version": 5}},
    }
    for name, body in odd.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "run_manifest.json").write_text(json.dumps(body))
    got = {r["name"]: r for r in manifests(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and all(r["problem"] is None for r in got.values())
    a = got["x_aware_1"]  # the name outweighs the factor; what is no flag is the default
    assert (a["missing_indicators_enabled"], a["dl_enabled"], a["sentiment_enabled"], a["surface_source"]) == (True, True, True, "missing_experiment_surface")
    assert got["both_aware-1_blind"]["missing_indicators_enabled"] is True and got["both_aware-1_blind"]["run_id"] is None
    assert (got["list"]["sentiment_enabled"], got["list"]["sentiment_surface"], got["list"]["surface_semantics_version"], got["list"]["surface_source"]) == (None, "no_sentiment", None, "legacy_variant_fallback")
    assert (got["boolean"]["dl_enabled"], got["boolean"]["sentiment_surface"], got["boolean"]["surface_semantics_version"]) == (False, "sentiment", 5)
    assert got["array"]["generation"] is None and got["null"]["surface_source"] == "legacy_variant_fallback"


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
def test_every_rule_of_an_archive_finds_something(spark):
    from tidemark.plans import registry

    rows = registry.QUERIES["q13_archive_validation"](spark, SF).collect()
    begun = {r["message"].split(" ")[0] + r["message"].split(" ")[1] for r in rows}
    assert begun >= {"runid", "semanticid", "manifestid", "2manifests", "nomanifest", "notJSON", "generationgen1", "variantF", "noexperiment", "cohortstands", "noexperiment_seed,", "equalseed"}
    assert any("column order" in r["message"] for r in rows) and any("other seeds" in r["message"] for r in rows) and any(r["message"].startswith("time ") for r in rows)


def test_logs_over_blocks_are_those_of_a_plain_loop(spark, tmp_path):
    from tidemark.sources import archive

    lines, expected, pair, inside = [], [], None, False
    for k in range(4000):
        kind = k * 7919 % 23
        line = {0: f"--- PAIR{chr(65 + k % 26)}{chr(65 + k % 7)} ---", 1: f"Phase as Feature 0.{k} 0.1 {k}", 2: "ML Backtest Results Summary", 3: "[4/5] next", 4: f"EURUSD {k} -1 2.5 50 {k}", 5: "", 6: f"late warning {k}", 7: f"[DL] EURUSD: DL coverage (any col)={k}.5% WARNING"}.get(kind, "x" * (k % 50))
        lines.append(line)
        if kind == 0:
            pair = line[4:10]
        if kind == 1 and pair:
            expected.append(("score", k + 1, pair, k))
        if kind in (2, 3):
            inside = kind == 2
        if kind == 4 and inside:
            expected.append(("trades", k + 1, "EURUSD", k))
        if kind == 7:
            expected.append(("coverage", k + 1, "EURUSD", None))
        if kind in (6, 7):
            expected.append(("warning", k + 1, None, None))
    os.makedirs(tmp_path / "run")
    (tmp_path / "run" / "a.txt").write_text("\n".join(lines))
    (tmp_path / "run" / "b.txt").write_text("--- EURUSD ---\nPhase as Feature 1 1 1\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "4096")
        got = [(r["kind"], r["line"], r["pair"], r["n"]) for r in archive.log_records(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_a_benchmark_with_faults(spark, tmp_path):
    from tidemark.sources import benchmark

    def folder(name, surface, **files):
        os.makedirs(tmp_path / name)
        if surface is not None:
            (tmp_path / name / "run_manifest.json").write_text(json.dumps({"experiment_surface": surface}))
        for f, body in files.items():
            (tmp_path / name / f"{f}.csv").write_text(body)

    head = "Pair,Strategy,Sharpe Ratio,N Trades\n"
    folder("baseline", {"behavioral_surface": "trend_vol", "artifact_model": "mlp"}, results_per_pair__baseline=head + "EURJPY,PhaseAware_a,1,3\nEURJPY,PhaseAware_b,2,4\nUSDJPY,TF1,1,1\n", results_per_pair__dl_enabled=head)
    folder("one", {"behavioral_surface": "trend_vol", "artifact_model": "mlp"}, results_per_pair=head, walkforward_results_per_pair="Pair,Sharpe Δ,Folds\nEURJPY,0.5,3\n", walkforward_results_summary="Sharpe Δ,Folds\n0.25,3\n", baseline_vs_dynamic_comparison="Pair,Sharpe Δ\nEURJPY,1\nEURJPY,2\n")
    folder("two", None, walkforward_results_per_pair="Pair\nEURJPY\n")
    rows, problems = benchmark.load(spark, str(tmp_path))
    got = {(r["name"], r["strategy"]): r for r in rows.collect()}
    assert set(got) == {("baseline", "PhaseAware_a"), ("baseline", "PhaseAware_b"), ("one", None)}
    one = got[("one", None)]
    assert (one["suffix"], one["sharpe_delta"], one["n_folds"], one["compared_sharpe_delta"], one["summary_sharpe_delta"], one["selector_strategy"]) == ("", 0.5, 3, 2.0, 0.25, None)
    assert {(r["name"], r["problem"]) for r in problems.collect()} == {
        ("baseline", "more than one PhaseAware row: EURJPY"), ("baseline", "a baseline with files of an experiment"), ("two", "no single manifest"), ("two", "no results"), ("two", "no walk-forward results"),
    }
    assert {(r["section"], r["run_id"], r["message"]) for r in benchmark.benchmark_problems(rows).collect()} == {("targets", "baseline", "GBPJPY,USDJPY"), ("targets", "one", "GBPJPY,USDJPY")}
