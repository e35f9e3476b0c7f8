"""Queries: archives of experiment runs, written by Spark from the table of runs with faults planted, then read as they would be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import derive as D
from tidemark.plans.core import query
from tidemark.plans.q_stateful import _folder, _write_named
from tidemark.sources import archive, benchmark, manifests
from tidemark.sources.delimited import name_of
from tidemark.storage import materialise

# one row per run; its number k decides the manifest's kind g and what is wrong with it
_M = """SELECT *, generation || '_' || variant || '__' || stamp || CASE k % 4 WHEN 0 THEN '_aware' WHEN 1 THEN '_blind' ELSE '' END AS name,
    CASE WHEN k % 11 = 4 THEN 'F' ELSE variant END AS mv, CASE WHEN k % 13 <> 6 THEN generation WHEN generation = 'gen1' THEN 'gen2' ELSE 'gen1' END AS mg,
    CASE WHEN g > 0 THEN CASE WHEN k % 10 = 3 THEN '20250101T000000Z' ELSE stamp END END AS made, 'm' || CASE WHEN k < 10 THEN k // 2 ELSE k END AS id FROM (
    SELECT *, (['A','B','C','D','E','F'])[k // 8 + 1] AS variant, '20260101T' || lpad(CAST(k AS VARCHAR), 6, '0') || 'Z' AS stamp, k % 3 AS g FROM (
    SELECT DISTINCT CAST(run_id[5:7] AS INTEGER) AS k, generation, family, aware, sentiment FROM runs))"""
_VALID = f"SELECT * FROM (SELECT *, unnest(range(CASE WHEN k % 16 = 0 THEN 2 ELSE 1 END)) AS copy FROM ({_M})) WHERE k % 12 NOT IN (5, 7) AND k <> 12"


def _runs(spark, sf):
    """The runs as `_M` has them."""
    k, g = F.col("k"), F.col("k") % 3
    r = D.runs(spark, sf).select(F.substring("run_id", 5, 3).cast("int").alias("k"), "generation", "aware", "sentiment").distinct()
    r = r.withColumns({"variant": F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.floor(k / 8) + 1).cast("int")), "stamp": F.concat(F.lit("20260101T"), F.lpad(k.cast("string"), 6, "0"), F.lit("Z")), "g": g})
    named = F.concat("generation", F.lit("_"), "variant", F.lit("__"), "stamp", F.when(k % 4 == 0, "_aware").when(k % 4 == 1, "_blind").otherwise(""))
    return r.withColumns({
        "name": named, "mv": F.when(k % 11 == 4, "F").otherwise(F.col("variant")), "mg": F.when(k % 13 != 6, F.col("generation")).when(F.col("generation") == "gen1", "gen2").otherwise("gen1"),
        "made": F.when(g > 0, F.when(k % 10 == 3, "20250101T000000Z").otherwise(F.col("stamp"))), "id": F.concat(F.lit("m"), F.when(k < 10, F.floor(k / 2)).otherwise(k).cast("string")),
    })


def _manifest():
    """A run's manifest: an older one, one without a surface, or a whole one."""
    k, s = F.col("k"), F.struct
    flags = [F.col("sentiment").alias("sentiment_enabled"), F.col("aware").alias("missing_indicators_enabled")]
    named = [F.col("mg").alias("generation"), F.col("mv").alias("variant")]
    run = s(F.col("id").alias("run_id"), F.col("made").alias("timestamp_utc"), F.lit("abc").alias("git_sha")).alias("run")
    older = s(F.col("id").alias("run_id"), s((k % 2 == 0).alias("dl_enabled"), F.lit(" d ").alias("dl_surface")).alias("dl"), s(*named, *flags, F.lit(True).alias("legacy_semantics")).alias("experiment"))
    middle = s(run, s(*named, s(*flags, F.lit(" hvtf ").alias("msml_regime")).alias("factors"), F.lit("L").alias("semantic_label"), F.lit(3).alias("semantics_version")).alias("experiment"), s((k % 4).alias("experiment_seed"), (k % 5).alias("numpy_seed")).alias("reproducibility"))
    surface = s(F.lit(" parquet ").alias("surface_source"), F.when(F.col("sentiment"), "Sentiment").otherwise("none").alias("sentiment_surface"), F.lit("price").alias("feature_surface"), F.lit("5").alias("surface_semantics_version"))
    order = F.when(k % 9 == 2, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    ordering = s(F.create_map(F.lit("EURUSD"), order, F.lit("USDJPY"), F.array(F.lit("c"))).alias("phase_predictor_by_pair"))
    seeds = s((k % 4).alias("experiment_seed"), *[F.lit(7).alias(c) for c in manifests.SEEDS[1:]])
    whole = s(run, s(*named, s(*flags).alias("factors")).alias("experiment"), surface.alias("experiment_surface"), seeds.alias("reproducibility"), ordering.alias("feature_ordering"), s((k % 5 != 0).alias("dl_enabled")).alias("dl"), s(F.lit(True).alias("a")).alias("flags"))
    return F.when(k == 12, "{broken").when(F.col("g") == 0, F.to_json(older)).when(F.col("g") == 1, F.to_json(middle)).otherwise(F.to_json(whole))


def _archive(spark, sf) -> str:
    """Runs in two batches: manifests, a CSV file each, markers, and folders below a run; some have no manifest, two, a broken one, or a namesake."""
    root, k = _folder(spark), F.col("k")
    r = materialise(_runs(spark, sf).withColumn("value", _manifest()))

    def text(rows, batch: str, file: str, *below: str, value=None):
        named = rows.select(F.lit(batch).alias("batch"), F.col("name").alias("run_id"), *[F.lit(b).alias("below") for b in below], F.lit(file).alias("file"), F.col("value") if value is None else F.lit(value).alias("value"))
        named.write.mode("append").partitionBy("batch", "run_id", *["below" for _ in below], "file").text(root)

    text(r.filter(k % 12 != 7), "one", "run_manifest.json")
    text(r.filter(k % 12 == 5), "one", "run_manifest_2.json")
    text(r.filter(k % 16 == 0), "two", "run_manifest.json")
    text(r.filter((k % 12 == 7) & (k % 8 == 7)), "one", archive.LEGACY_MARKER, value="x")
    text(r.filter(k % 6 == 0), "one", "run_manifest.json", "x", value="{}")
    csv = r.select(F.lit("one").alias("batch"), F.col("name").alias("run_id"), F.lit("walkforward_results_per_pair__baseline.csv").alias("file"), F.col("stamp").alias("pair"))
    csv.write.mode("append").partitionBy("batch", "run_id", "file").option("header", True).csv(root)
    return root


@query(
    "kind:s generation:s folders:i manifests:i csvs:i",
    f"""SELECT kind, generation, count(*) AS folders, sum(n) AS manifests, sum(c) AS csvs FROM (
        SELECT CASE WHEN k % 12 = 5 THEN 'several manifests' WHEN k % 12 <> 7 THEN 'run' WHEN k % 8 = 7 THEN 'legacy' ELSE 'other' END AS kind, CASE WHEN k % 12 IN (5, 7) OR k = 12 THEN 'unknown' ELSE mg END AS generation,
               CASE k % 12 WHEN 5 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS n, 1 AS c FROM ({_M}) UNION ALL SELECT 'run', mg, 1, 0 FROM ({_M}) WHERE k % 16 = 0) GROUP BY 1, 2""", "runs",
)
def src10_discovery(spark, sf):
    """Folders of an archive by kind and by the generation that a run's manifest states."""
    root = _archive(spark, sf)
    stated = manifests.manifests(spark, root).filter(F.col("problem").isNull() & F.col("generation").isin(*manifests.GENERATIONS)).select("folder", "generation")
    found = archive.discover(spark, root).join(stated, "folder", "left").fillna("unknown", ["generation"])
    return found.groupBy("kind", "generation").agg(F.count("*").alias("folders"), F.sum("manifests").alias("manifests"), F.sum("csvs").alias("csvs"))


@query(
    "name:s file:s run_id:s generation:s variant:s timestamp_utc:s git_sha:s semantic_label:s semantics_version:i legacy_semantics:b dl_enabled:b dl_surface:s sentiment_enabled:b missing_indicators_enabled:b msml_regime:s overlap_only:b selector_enabled:b surface_source:s sentiment_surface:s feature_surface:s surface_semantics_version:i experiment_seed:i numpy_seed:i torch_seed:i flags:s n_manifests:i problem:s",
    f"""SELECT name, file, CASE WHEN ok THEN id END AS run_id, CASE WHEN ok THEN mg END AS generation, CASE WHEN ok THEN mv END AS variant, CASE WHEN ok THEN made END AS timestamp_utc, CASE WHEN g > 0 THEN 'abc' END AS git_sha,
        CASE WHEN g = 1 THEN 'L' END AS semantic_label, CASE WHEN g = 1 THEN 3 END AS semantics_version, g = 0 AND ok AS legacy_semantics,
        CASE WHEN ok THEN CASE g WHEN 0 THEN k % 2 = 0 WHEN 1 THEN true ELSE k % 5 <> 0 END END AS dl_enabled, CASE WHEN ok AND g = 0 THEN 'd' END AS dl_surface, CASE WHEN ok THEN sentiment END AS sentiment_enabled,
        CASE WHEN ok THEN CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE aware END END AS missing_indicators_enabled, CASE WHEN ok THEN CASE g WHEN 1 THEN 'HVTF' ELSE 'LVTF' END END AS msml_regime,
        CASE WHEN ok THEN false END AS overlap_only, CASE WHEN ok THEN true END AS selector_enabled,
        CASE WHEN ok THEN CASE g WHEN 0 THEN 'legacy_variant_fallback' WHEN 1 THEN 'missing_experiment_surface' ELSE 'parquet' END END AS surface_source,
        CASE WHEN g = 2 THEN CASE WHEN sentiment THEN 'sentiment' ELSE 'none' END END AS sentiment_surface, CASE WHEN g = 2 THEN 'price' END AS feature_surface, CASE WHEN g = 2 THEN 5 END AS surface_semantics_version,
        CASE WHEN g > 0 THEN k % 4 END AS experiment_seed, CASE g WHEN 1 THEN k % 5 WHEN 2 THEN 7 END AS numpy_seed, CASE WHEN g = 2 THEN 7 END AS torch_seed, CASE WHEN g = 2 THEN '{{"a":true}}' END AS flags,
        CASE WHEN k % 12 = 5 THEN 2 ELSE 1 END AS n_manifests, CASE WHEN NOT ok THEN 'not JSON' WHEN k % 12 = 5 THEN 'several manifests in a folder' END AS problem
        FROM (SELECT *, k <> 12 AS ok, unnest(CASE WHEN k % 12 = 5 THEN ['run_manifest.json', 'run_manifest_2.json'] WHEN k % 16 = 0 THEN ['run_manifest.json', 'run_manifest.json'] ELSE ['run_manifest.json'] END) AS file FROM ({_M}) WHERE k % 12 <> 7)""", "runs",
)
def src11_manifests(spark, sf):
    """Manifests of three generations as one flat table, with those that count for nothing."""
    root = _archive(spark, sf)
    return manifests.manifests(spark, root).join(archive.discover(spark, root).select("folder"), "folder", "left_semi")


_SHARED = f"SELECT CAST(k % 4 AS VARCHAR) || '::' || CASE WHEN g = 1 THEN 'unknown' ELSE 'price' END AS run_id, * FROM ({_VALID}) WHERE g > 0"


@query(
    "section:s severity:s run_id:s message:s",
    f"""SELECT 'provenance' AS section, 'error' AS severity, name AS run_id, 'run id stands 2 times' AS message FROM ({_M}) WHERE k % 16 = 0
        UNION ALL SELECT 'provenance', 'error', s, 'semantic id stands ' || count(*) || ' times' FROM (SELECT mg || '_' || mv || '__' || coalesce(made, stamp) AS s FROM ({_VALID})) GROUP BY s HAVING count(*) > 1
        UNION ALL SELECT 'reproducibility', 'warning', id, 'manifest id stands ' || count(*) || ' times' FROM ({_VALID}) GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'manifest', 'error', name, '2 manifests' FROM ({_M}) WHERE k % 12 = 5 UNION ALL SELECT 'manifest', 'warning', name, 'no manifest' FROM ({_M}) WHERE k % 12 = 7
        UNION ALL SELECT 'manifest', 'error', name, 'not JSON' FROM ({_M}) WHERE k = 12
        UNION ALL SELECT 'manifest', 'error', name, 'time ' || made || ' is not that of the name' FROM ({_VALID}) WHERE made <> stamp
        UNION ALL SELECT 'semantic', 'error', name, 'generation ' || mg || ' is not that of the name' FROM ({_VALID}) WHERE mg <> generation
        UNION ALL SELECT 'semantic', 'error', name, 'variant ' || mv || ' is not that of the name' FROM ({_VALID}) WHERE mv <> variant
        UNION ALL SELECT 'semantic', 'error', name, 'no experiment surface' FROM ({_VALID}) WHERE g = 1
        UNION ALL SELECT 'semantic', 'warning', mg || '_' || mv, 'cohort stands ' || count(*) || ' times' FROM ({_VALID}) WHERE g > 0 GROUP BY mg, mv HAVING count(*) > 1
        UNION ALL SELECT 'reproducibility', 'warning', name, CASE g WHEN 0 THEN 'no experiment_seed, numpy_seed, python_random_seed, torch_seed' ELSE 'no python_random_seed, torch_seed' END FROM ({_VALID}) WHERE g < 2
        UNION ALL SELECT 'reproducibility', 'warning', run_id, 'equal seed and surface, other seeds' FROM ({_SHARED}) GROUP BY run_id HAVING count(DISTINCT CASE WHEN g = 1 THEN k % 5 ELSE 7 END) > 1
        UNION ALL SELECT 'reproducibility', 'warning', run_id, 'equal seed and surface, other column order: phase_predictor_by_pair:EURUSD' FROM ({_SHARED}) WHERE g = 2 GROUP BY run_id HAVING count(DISTINCT k % 9 = 2) > 1""", "runs",
)
def q13_archive_validation(spark, sf):
    """All that is wrong with an archive, in one table."""
    root = _archive(spark, sf)
    return manifests.archive_problems(materialise(archive.discover(spark, root)), materialise(manifests.manifests(spark, root)))


_CODE = "'PAI' || translate(lpad(pair[2:], 2, '0'), '0123456789', 'ABCDEFGHIJ') || 'X'"


def _code():
    return F.concat(F.lit("PAI"), F.translate(F.lpad(F.expr("substring(pair, 2)"), 2, "0"), "0123456789", "ABCDEFGHIJ"), F.lit("X"))


@query(
    "run_id:s file:s line:i kind:s pair:s label:s a:f b:f c:f d:f n:i text:s",
    f"""WITH l AS (SELECT *, {_CODE} AS code, row_number() OVER w AS place, count(*) OVER (PARTITION BY run_id) AS total FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY row_id))
        SELECT run_id, 'a_run.txt' AS file, 4 * place - 2 AS line, 'score' AS kind, code AS pair, 'Phase as Feature' AS label, row_id % 1000 / 1000 AS a, 0.5 AS b, NULL AS c, NULL AS d, row_id AS n, NULL AS text FROM l
        UNION ALL SELECT run_id, 'a_run.txt', 4 * place - 1, 'coverage', code, NULL, row_id % 100 + 0.5, NULL, NULL, NULL, NULL, NULL FROM l
        UNION ALL SELECT run_id, 'a_run.txt', 4 * place, 'warning', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'WARNING ' || row_id FROM l WHERE row_id % 5 = 0
        UNION ALL SELECT run_id, 'a_run.txt', 4 * total + 3 + place, 'trades', code, NULL, -1.5, row_id % 7, -2.5, 50.0, row_id, NULL FROM l""", "runs",
)
def src13_logs(spark, sf):
    """Logs written as text files, one for each run and a second that does not count, and read as records."""
    path = _folder(spark)
    r = materialise(D.runs(spark, sf).withColumn("code", _code()))
    n = F.col("row_id")
    head = F.array(
        F.concat(F.lit("--- "), "code", F.lit(" ---")), F.concat(F.lit("  Phase as Feature   "), F.format_string("%.3f", n % 1000 / 1000), F.lit(" 0.5 "), n.cast("string")),
        F.concat(F.lit("[DL] "), "code", F.lit(": DL coverage (any col)="), (n % 100).cast("string"), F.lit(".5%")), F.when(n % 5 == 0, F.concat(F.lit(" WARNING "), n.cast("string"))).otherwise(""),
    )
    row = F.concat("code", F.lit(" -1.5 "), (n % 7).cast("string"), F.lit(" -2.5 50.0 "), n.cast("string"))
    line = lambda phase, text: r.select("run_id", F.lit("a_run.txt").alias("file"), F.lit(phase).alias("phase"), n.alias("at"), F.posexplode(text).alias("k", "value"))
    marks = lambda phase, *texts: r.select("run_id").distinct().select("run_id", F.lit("a_run.txt").alias("file"), F.lit(phase).alias("phase"), F.lit(0).alias("at"), F.posexplode(F.array(*map(F.lit, texts))).alias("k", "value"))
    # a row of the table outside of it, before and after, is none
    first = line(0, head).union(marks(1, "PAIAAX -1 1 -1 50 9", "== ML Backtest Results Summary ==", "Pair Return Sharpe")).union(line(2, F.array(row))).union(marks(3, "[4/5] next", "PAIAAX -1 1 -1 50 9"))
    second = first.withColumn("file", F.lit("b_other.txt"))
    _write_text(first.unionByName(second), path)
    return archive.log_records(spark, path)


def _write_text(rows, path: str) -> None:
    rows.repartition("run_id", "file").sortWithinPartitions("run_id", "file", "phase", "at", "k").select("run_id", "file", "value").write.mode("append").partitionBy("run_id", "file").text(path)


@query(
    "family:s run_id:s mode:s n:i total:f problems:i",
    """SELECT family, run_id, 'baseline' AS mode, count(*) AS n, sum(CASE WHEN row_id % 10 = 0 THEN NULL ELSE sharpe END) AS total, CASE WHEN any_value(bad) THEN 1 ELSE 0 END AS problems FROM (
        SELECT *, max(CASE WHEN row_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, family) = 1 AS bad FROM (SELECT run_id, sharpe, row_id, (['results_ml_backtest', 'results_summary', 'results_per_pair'])[row_id % 3 + 1] AS family FROM runs)) GROUP BY 1, 2""", "runs",
)
def src12_all_families(spark, sf):
    """All families of result files from one scan, with how many files have text in place of a number."""
    path = _folder(spark)
    family = F.element_at(F.array(F.lit("results_ml_backtest"), F.lit("results_summary"), F.lit("results_per_pair")), (F.col("row_id") % 3 + 1).cast("int"))
    r = D.runs(spark, sf).select("run_id", F.concat(family, F.lit("__baseline.csv")).alias("file"), F.col("pair").alias("Pair"), F.when(F.col("row_id") % 10 == 0, "n/a").otherwise(F.col("sharpe").cast("string")).alias("Sharpe Ratio"), F.lit("TF1").alias("Strategy"))
    r.repartition("run_id", "file").write.mode("append").partitionBy("run_id", "file").option("header", True).csv(path)
    tables, problems = archive.all_results(spark, path)
    kept = [t.select(F.lit(f).alias("family"), "run_id", "mode", "sharpe") for f, t in tables.items() if "sharpe" in archive.FAMILIES[f]]
    rows = kept[0]
    for t in kept[1:]:
        rows = rows.unionByName(t)
    found = problems.select("family", F.regexp_extract("file", "/run_id=([^/]+)/", 1).alias("run_id")).groupBy("family", "run_id").agg(F.count("*").alias("problems"))
    return rows.groupBy("family", "run_id", "mode").agg(F.count("*").alias("n"), F.sum("sharpe").alias("total")).join(found, ["family", "run_id"], "left").fillna(0, ["problems"])


# a benchmark: run 0 is the baseline; others lack a pair, have one more, or another representation
_B = """SELECT *, CASE WHEN k = 0 THEN 'baseline' ELSE 'exp_' || k END AS name, CASE WHEN k > 0 AND k % 5 = 0 THEN 'other' WHEN k % 2 = 0 THEN 'reactive_jpy' ELSE 'trend_vol' END AS representation, CASE WHEN k % 7 = 3 THEN 'lstm' ELSE 'mlp' END AS architecture,
    CASE WHEN k = 0 THEN '__baseline' WHEN k % 4 = 1 THEN '' WHEN k % 4 = 2 THEN '__baseline' ELSE '__dl_enabled' END AS suffix FROM (
    SELECT k, pair, avg(sharpe) AS v FROM (SELECT CAST(run_id[5:7] AS INTEGER) AS k, (['EURJPY', 'GBPJPY', 'USDJPY', 'AUDJPY'])[row_id % 4 + 1] AS pair, sharpe FROM (SELECT run_id, sharpe, row_id // 48 AS row_id FROM runs)) GROUP BY 1, 2)
    WHERE NOT (pair = 'AUDJPY' AND k % 6 <> 1) AND NOT (pair = 'GBPJPY' AND k % 8 = 3)"""


def _benchmark(spark, sf) -> str:
    path, k, v = _folder(spark), F.col("k"), F.col("v")
    pair = F.element_at(F.array(*map(F.lit, ("EURJPY", "GBPJPY", "USDJPY", "AUDJPY"))), (F.floor(F.col("row_id") / 48) % 4 + 1).cast("int"))
    b = D.runs(spark, sf).select(F.substring("run_id", 5, 3).cast("int").alias("k"), pair.alias("pair"), "sharpe").groupBy("k", "pair").agg(F.avg("sharpe").alias("v"))
    b = b.filter(~((F.col("pair") == "AUDJPY") & (k % 6 != 1)) & ~((F.col("pair") == "GBPJPY") & (k % 8 == 3)))
    suffix = F.when(k == 0, "__baseline").when(k % 4 == 1, "").when(k % 4 == 2, "__baseline").otherwise("__dl_enabled")
    b = materialise(b.withColumns({"name": F.when(k == 0, "baseline").otherwise(F.concat(F.lit("exp_"), k.cast("string"))), "suffix": suffix}))
    representation = F.when((k > 0) & (k % 5 == 0), "other").when(k % 2 == 0, "reactive_jpy").otherwise("trend_vol")
    surface = F.struct(F.when(k % 7 == 3, "lstm").otherwise("mlp").alias("artifact_model"), representation.alias("behavioral_surface"), F.when(k % 3 == 0, "s").alias("behavioral_state"), F.lit("LVTF").alias("msml_regime"))
    head = b.select("name", F.lit("run_manifest.json").alias("file"), F.to_json(F.struct(surface.alias("experiment_surface"))).alias("value")).distinct()
    head.repartition("name").write.mode("append").partitionBy("name", "file").text(path)

    def write(stem: str, rows, *columns, ending="suffix"):
        named = rows.select("name", F.concat(F.lit(stem), ending if isinstance(ending, str) else ending, F.lit(".csv")).alias("file"), F.col("pair").alias("Pair"), *columns)
        named.repartition("name").write.mode("append").partitionBy("name", "file").option("header", True).csv(path)

    metrics = [v.alias("Total Return (%)"), (v + 1).alias("Sharpe Ratio"), (v + 2).alias("Max Drawdown (%)"), F.lit(50.0).alias("Win Rate (%)"), F.lit(1.5).alias("Profit Factor"), k.alias("N Trades")]
    write("results_per_pair", b.crossJoin(spark.range(2)), F.when(F.col("id") == 0, "PhaseAware_x").otherwise("TF1").alias("Strategy"), *metrics)
    # a baseline may hold files of an experiment, and experiments those of others of later rank: they are not read
    write("walkforward_results_per_pair", b, (v * 2).alias("Return Δ"), (v * 3).alias("Sharpe Δ"), (v * 4).alias("DD Δ"), F.lit(7).alias("Folds"))
    write("walkforward_results_per_pair", b.filter("suffix = '__dl_enabled'"), F.lit(-9).alias("Return Δ"), ending=F.lit("__baseline"))
    write("dynamic_selector_results_per_pair", b.filter(k % 9 != 4), F.lit("TF2").alias("Strategy"), v.alias("Total Return (%)"), (v * 5).alias("Sharpe"), v.alias("Max DD (%)"), k.alias("Num Trades"))
    return path


@query(
    "name:s is_baseline:b suffix:s architecture:s representation:s pair_family:s state:s pair:s total_return:f sharpe:f total_trades:i return_delta:f sharpe_delta:f maxdd_delta:f n_folds:i selector_strategy:s selector_sharpe:f compared_sharpe_delta:f",
    f"""SELECT name, k = 0 AS is_baseline, suffix, architecture, representation, 'unknown' AS pair_family, CASE WHEN k % 3 = 0 THEN 's' ELSE 'LVTF' END AS state, pair, CASE WHEN k = 0 THEN v END AS total_return, CASE WHEN k = 0 THEN v + 1 END AS sharpe,
        CASE WHEN k = 0 THEN k END AS total_trades, CASE WHEN k > 0 THEN v * 2 END AS return_delta, CASE WHEN k > 0 THEN v * 3 END AS sharpe_delta, CASE WHEN k > 0 THEN v * 4 END AS maxdd_delta, CASE WHEN k > 0 THEN 7 END AS n_folds,
        CASE WHEN k % 9 <> 4 THEN 'TF2' END AS selector_strategy, CASE WHEN k % 9 <> 4 THEN v * 5 END AS selector_sharpe, NULL AS compared_sharpe_delta FROM ({_B})""", "runs",
)
def src14_benchmark(spark, sf):
    """A benchmark archive loaded: baseline and experiments, each from the files that count."""
    return benchmark.load(spark, _benchmark(spark, sf))[0]


@query(
    "name:s severity:s problem:s", f"SELECT DISTINCT name, 'warning' AS severity, 'an experiment with files of a baseline' AS problem FROM ({_B}) WHERE k > 0 AND suffix = '__baseline'", "runs",
)
def src14_benchmark_problems(spark, sf):
    """What keeps folders of the benchmark from being whole."""
    return benchmark.load(spark, _benchmark(spark, sf))[1]


_P = f"SELECT name, any_value(k) AS k, any_value(representation) AS representation, list_sort(list(pair)) AS pairs FROM ({_B}) GROUP BY name"


@query(
    "section:s severity:s run_id:s message:s",
    f"""SELECT 'universe' AS section, 'error' AS severity, p.name AS run_id, 'lacks ' || array_to_string(list_filter(b.pairs, lambda x: NOT list_contains(p.pairs, x)), ',') || '; beyond ' || array_to_string(list_filter(p.pairs, lambda x: NOT list_contains(b.pairs, x)), ',') AS message
        FROM ({_P}) p, (SELECT * FROM ({_P}) WHERE k = 0) b WHERE p.pairs <> b.pairs
        UNION ALL SELECT 'architecture', 'warning', 'all', string_agg(DISTINCT architecture, ',' ORDER BY architecture) FROM ({_B}) WHERE k > 0 HAVING count(DISTINCT architecture) > 1
        UNION ALL SELECT 'population', 'error', name, 'other' FROM ({_P}) WHERE representation = 'other'
        UNION ALL SELECT 'targets', 'error', name, array_to_string(list_filter(['EURJPY', 'GBPJPY', 'USDJPY'], lambda x: NOT list_contains(pairs, x)), ',') FROM ({_P}) WHERE representation <> 'other' AND NOT list_has_all(pairs, ['EURJPY', 'GBPJPY', 'USDJPY'])""", "runs",
)
def q16_benchmark(spark, sf):
    """Whether a benchmark's folders can be held against one another."""
    return benchmark.benchmark_problems(benchmark.load(spark, _benchmark(spark, sf))[0])
