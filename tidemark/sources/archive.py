"""Archives of experiment runs: found, parsed and joined as tables, all runs in one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import blocks
from tidemark.sources.delimited import file_problems, folder_of, lines_of, logical_path, name_of, read_by_name, value_of
from tidemark.sources.manifests import MANIFEST_FILE
from tidemark.storage import materialise

# What makes a folder without a manifest a run of the older kind.
LEGACY_MARKER, LEGACY_RESULTS = "legacy_run_root", r"^(results_ml|walkforward_results|results_summary).*\.csv$"
# Names under which older results have the same columns.
RENAMED = {
    "sharpe_dynamic": ("Sharpe_Dynamic", "Dynamic Sharpe"), "sharpe_baseline": ("Sharpe_Baseline", "Baseline Sharpe"), "sharpe_delta": ("Sharpe_Delta", "Sharpe Δ"),
    "return_dynamic": ("Return_Dynamic", "Dynamic Return"), "return_baseline": ("Return_Baseline", "Baseline Return"), "return_delta": ("Return_Delta", "Return Δ"),
    "maxdd_dynamic": ("MaxDD_Dynamic", "Dynamic Max DD"), "maxdd_baseline": ("MaxDD_Baseline", "Baseline Max DD"), "maxdd_delta": ("MaxDD_Delta", "DD Δ"),
    "total_return": ("Total Return (%)",), "sharpe": ("Sharpe Ratio", "Sharpe"), "max_drawdown": ("Max Drawdown (%)", "Max DD (%)"), "win_rate": ("Win Rate (%)",),
    "profit_factor": ("Profit Factor",), "total_trades": ("Total Trades", "Num Trades", "N Trades"), "n_folds": ("Folds",), "n_samples": ("N Samples",), "dl_active": ("dl_available",),
}
_DELTAS = dict.fromkeys(("sharpe_dynamic", "sharpe_baseline", "sharpe_delta", "return_dynamic", "return_baseline", "return_delta", "maxdd_dynamic", "maxdd_baseline", "maxdd_delta"), "double")
_FOLDS = {"pair": "string", **_DELTAS, "n_folds": "int"}
_METRICS = {"pair": "string", "strategy": "string", **dict.fromkeys(("total_return", "sharpe", "max_drawdown", "win_rate", "profit_factor"), "double"), "total_trades": "int"}
_ABLATION = {"model": "string", **dict.fromkeys(("accuracy", "std", "improvement"), "double"), "n_samples": "int"}
_GUARD = {**dict.fromkeys(("guard_rate", "atr_quantile", "vol_threshold"), "double"), "n_suppressed": "int", "n_total": "int"}
# The families of result files, and the columns of each.
FAMILIES = {
    "results_ml": {"model": "string", "accuracy": "double", "std": "double", "n_samples": "int", "pair": "string"},
    "results_ml_backtest": _METRICS,
    "walkforward_results_summary": _FOLDS,
    "walkforward_results_per_pair": _FOLDS,
    "walkforward_results_per_fold": {
        "pair": "string", "fold": "int", **_DELTAS, "dl_overlap_pct": "double", "dl_overlap_active": "boolean", "dl_overlap_state": "string", "dl_overlap_window": "string",
        "fold_test_start": "string", "fold_test_end": "string",
    },
    "baseline_vs_dynamic_comparison": {"pair": "string", **_DELTAS, "winrate_baseline": "double", "winrate_dynamic": "double", "trades_baseline": "int", "trades_dynamic": "int"},
    "ablation_summary_aggregate": {**_ABLATION, "n_pairs": "int"},
    "ablation_summary_per_pair": {"pair": "string", **_ABLATION},
    "vol_guard_diagnostics_summary": {**_GUARD, "n_folds": "int"},
    "vol_guard_diagnostics_per_fold": {"pair": "string", "fold": "int", **_GUARD},
    "results_summary": {**_METRICS, "dl_coverage_pct": "double"},
    "results_per_pair": {**_METRICS, "dl_coverage_pct": "double"},
    "selector_state_timeline": {
        "timestamp": "string", "pair": "string", "selected_strategy": "string", "selector_confidence": "double",
        **dict.fromkeys(("phaseaware_active", "volatility_guard_active", "dl_active", "dl_missing", "fallback_active", "switch_event"), "boolean"),
        "imputation_state": "string", "previous_strategy": "string", "current_strategy": "string",
    },
}


def discover(spark: SparkSession, root: str, marker: str = LEGACY_MARKER) -> DataFrame:
    """Per folder: manifests, logs and CSV files, and what it is. One manifest makes a run, more are an error; without any, a marker file
    and a CSV of a known family make a legacy run. Nothing below a run counts. Only names are read.

    Spark does not list files whose name starts with a dot or an underscore, so a marker must not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(logical_path(F.col("path")).alias("path")).distinct()
    named = files.select(folder_of(F.col("path")).alias("folder"), name_of(F.col("path")).alias("file"))
    count = lambda pattern: F.count_if(F.col("file").rlike(pattern))
    counts = named.groupBy("folder").agg(
        count(MANIFEST_FILE).alias("manifests"), count(r"\.csv$").alias("csvs"), count(r"\.txt$").alias("logs"),
        F.count_if(F.col("file") == marker).alias("markers"), count(LEGACY_RESULTS).alias("legacy_csvs"),
    )
    legacy = (F.col("markers") > 0) & (F.col("legacy_csvs") > 0)
    kind = F.when(F.col("manifests") == 1, "run").when(F.col("manifests") > 1, "several manifests").when(legacy, "legacy").otherwise("other")
    found = counts.withColumn("kind", kind).drop("markers", "legacy_csvs")
    runs = found.filter("kind in ('run', 'legacy')").select(F.col("folder").alias("root"))
    # a folder below a run has one of its parents among the runs: joined by equality on each parent path
    parts = F.split("folder", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = found.select("folder", F.explode(parents).alias("root")).join(runs, "root", "left_semi").select("folder").distinct()
    return found.join(below, "folder", "left_anti")


def family_files(spark: SparkSession, root: str, families: list[str]) -> DataFrame:
    """The rows of the files of some families with `family`, in one scan that lists no others (`read_by_name`)."""
    # the timeline has one file and no mode
    rows = read_by_name(spark, root, rf"^(({'|'.join(families)})__[a-z_]+|selector_state_timeline)\.csv$" if "selector_state_timeline" in families else rf"^({'|'.join(families)})__[a-z_]+\.csv$")
    return rows.withColumn("family", F.regexp_extract(name_of(F.col("file")), r"^(.*?)(__[a-z_]+)?\.csv$", 1)).filter(F.col("family").isin(*families))


def typed_column(column: str, kind: str) -> Column:
    """A column of rows read by name, under any of its names, cast as far as it can be."""
    value = value_of((column, *RENAMED.get(column, ())))
    if kind == "int":
        return value.try_cast("double").try_cast("int")
    if kind == "boolean":
        return F.lower(F.trim(value)).isin("true", "1", "yes")  # absent stays absent
    return value.try_cast(kind)


def result_tables(spark: SparkSession, root: str, family: str, columns: dict[str, str] | None = None) -> DataFrame:
    """All runs' rows of one family of result files (`<family>__<mode>.csv`): by name, with tolerant casts, older names mapped."""
    return typed_rows(family_files(spark, root, [family]), columns or FAMILIES[family])


def typed_rows(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`run_id, mode` and typed columns of rows read by name."""
    picked = [typed_column(c, kind).alias(c) for c, kind in columns.items()]
    run = F.regexp_extract(folder_of(F.col("file")), "([^/=]+)$", 1)
    return rows.select(run.alias("run_id"), F.regexp_extract(name_of(F.col("file")), r"__([a-z_]+)\.csv$", 1).alias("mode"), *picked)


def all_results(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every family's table, and `family, file, problem` of all files that are not as they should be: one scan, written once."""
    rows = materialise(family_files(spark, root, list(FAMILIES)))
    names = lambda c: (c, *RENAMED.get(c, ()))
    tables, problems = {}, []
    for family, columns in FAMILIES.items():
        own = rows.filter(F.col("family") == family)
        tables[family] = typed_rows(own, columns)
        numbers = [names(c) for c, kind in columns.items() if kind in ("int", "double")]
        first = next(iter(columns))
        problems.append(file_problems(own, [names(first)], numbers).select(F.lit(family).alias("family"), "file", "problem"))
    return tables, reduce(DataFrame.unionByName, problems)


def result_problems(spark: SparkSession, root: str, family: str, required: list[str]) -> DataFrame:
    """`file, problem` of the files of a family that are not as they should be; nothing is raised."""
    return file_problems(family_files(spark, root, [family]), [(c, *RENAMED.get(c, ())) for c in required])


# How the lines of a run's log look.
LOG_PAIR = r"---\s+([A-Z]{6})\s+---"
LOG_SCORE = r"^(Baseline \(No Phases\)|Phase as Feature|Separate Phase Models \(avg\))\s+([0-9.]+)\s+([0-9.]+)\s+([0-9]+)$"
LOG_COVERAGE = r"\[DL\]\s+([A-Z]{6}): DL coverage \(any col\)=([0-9.]+)%"
LOG_WARNING = r"(⚠️|WARNING|warning|Too few training samples)"
LOG_TRADES = r"^([A-Z]{6})\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+([0-9.]+)\s+([0-9]+)$"
TABLE_BEGINS, TABLE_ENDS = "ML Backtest Results Summary", "[4/5]"


def log_records(spark: SparkSession, root: str) -> DataFrame:
    """`run_id, file, line, kind, pair, label, a, b, c, d, n, text`: what the first log (`*.txt`) of each folder says.

    Kinds: `score` (label a model; a accuracy, b deviation, n samples) under the pair of the header before it; `trades` (a return,
    b Sharpe, c drawdown, d win rate, n trades), only between the lines that begin and end the table; `coverage` (a percent);
    `warning` (text). The pair, the table and the line's number are carried over the file's blocks, so that a long log is many tasks.
    A line can be of several kinds.
    """
    lines = lines_of(spark, root, r"\.txt$", empty=True)
    first = lines.groupBy(folder_of(F.col("file")).alias("folder")).agg(F.min("file").alias("file"))
    header = F.nullif(F.regexp_extract("value", LOG_PAIR, 1), F.lit(""))
    switch = F.when(F.col("value").contains(TABLE_BEGINS), True).when(F.startswith("value", F.lit(TABLE_ENDS)), False)
    marked = materialise(lines.join(first.select("file"), "file", "left_semi").select("file", F.struct("part", "place.block").alias("block"), "place", "value", header.alias("header"), switch.alias("switch"), F.lit(1).alias("line")))
    carried = blocks.last_value(blocks.last_value(blocks.running_sums(marked, ["file"], ["line"], "place"), ["file"], "header", "pair", "place"), ["file"], "switch", "inside", "place")
    text = F.trim("value")
    number = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("double")
    record = lambda kind, pair, label, values, n: F.struct(F.lit(kind).alias("kind"), pair.alias("pair"), label.alias("label"), *[x.alias(k) for x, k in zip(values, "abcd", strict=True)], n.try_cast("long").alias("n"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    score = F.when(text.rlike(LOG_SCORE) & F.col("pair").isNotNull(), record("score", F.col("pair"), F.regexp_extract(text, LOG_SCORE, 1), [number(LOG_SCORE, 2), number(LOG_SCORE, 3), nothing, nothing], F.regexp_extract(text, LOG_SCORE, 4)))
    trades = F.when(text.rlike(LOG_TRADES) & F.coalesce("inside", F.lit(False)), record("trades", F.regexp_extract(text, LOG_TRADES, 1), none, [number(LOG_TRADES, k) for k in (2, 3, 4, 5)], F.regexp_extract(text, LOG_TRADES, 6)))
    coverage = F.when(F.col("value").rlike(LOG_COVERAGE), record("coverage", F.regexp_extract("value", LOG_COVERAGE, 1), none, [number(LOG_COVERAGE, 2), nothing, nothing, nothing], none))
    warning = F.when(F.col("value").rlike(LOG_WARNING), record("warning", none, none, [nothing] * 4, none))
    found = carried.select("file", "line", text.alias("text"), F.explode(F.array_compact(F.array(score, trades, coverage, warning))).alias("r"))
    return found.select(F.regexp_extract(folder_of(F.col("file")), "([^/=]+)$", 1).alias("run_id"), name_of(F.col("file")).alias("file"), "line", "r.*", F.when(F.col("r.kind") == "warning", F.col("text")).alias("text"))


def experiments_from_names(names: DataFrame) -> DataFrame:
    """Family and flags that directory names tell."""
    n = F.lower("name")
    return names.withColumns({"family": F.regexp_extract(n, r"(jpy|eur|usd)", 1), "aware": n.contains("aware"), "sentiment": n.contains("sent"), "transfer": n.contains("transfer")})


def one_router_row(rows: DataFrame) -> DataFrame:
    """Pairs' rows of the phase-aware strategy, and whether a pair has other than one."""
    own = rows.filter(F.col("strategy").startswith("PhaseAware"))
    return own.withColumn("ambiguous", F.count("*").over(Window.partitionBy("run_id", "pair")) > 1)
