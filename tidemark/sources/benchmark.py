"""A benchmark archive: one baseline folder and one folder for each experiment, loaded together and held against one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import violations
from tidemark.sources.archive import typed_column
from tidemark.sources.delimited import folder_of, logical_path, name_of, read_by_name
from tidemark.sources.manifests import manifests
from tidemark.storage import materialise

# The endings of result files in the order in which they are looked for, and the pairs that a representation is judged by.
SUFFIXES = ("__dl_enabled", "__baseline", "")
POPULATIONS = {"reactive_jpy": ["EURJPY", "GBPJPY", "USDJPY"], "trend_vol": ["EURJPY", "GBPJPY", "USDJPY"]}
_METRICS = {"total_return": "double", "sharpe": "double", "max_drawdown": "double", "win_rate": "double", "profit_factor": "double", "total_trades": "int"}
_DELTAS = {"return_delta": "double", "sharpe_delta": "double", "maxdd_delta": "double"}
# The files of a folder and the columns of each.
TABLES = {
    "results_per_pair": {"strategy": "string", **_METRICS},
    "walkforward_results_per_pair": {**_DELTAS, "n_folds": "int"},
    "dynamic_selector_results_per_pair": {"strategy": "string", **{k: _METRICS[k] for k in ("total_return", "sharpe", "max_drawdown", "total_trades")}},
    "baseline_vs_dynamic_comparison": {f"{m}_{side}": "double" for m in ("return", "sharpe", "maxdd") for side in ("baseline", "dynamic", "delta")},
    "walkforward_results_summary": {**_DELTAS, "n_folds": "int"},
}


def _folders(spark: SparkSession, root: str, baseline: str) -> DataFrame:
    """`folder, name, is_baseline, suffix, suffixes`: an experiment's suffix is the first that its results have, the baseline's is fixed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(logical_path(F.col("path")).alias("path")).distinct()
    ending = F.regexp_extract(name_of(F.col("path")), r"^results_per_pair(__dl_enabled|__baseline)?\.csv$", 1)
    found = F.when(name_of(F.col("path")).rlike(r"^results_per_pair(__dl_enabled|__baseline)?\.csv$"), ending)
    per = listed.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.collect_set(found).alias("suffixes"))
    name = F.regexp_extract("folder", "([^/=]+)$", 1)
    first = F.coalesce(*[F.when(F.array_contains("suffixes", s), F.lit(s)) for s in SUFFIXES])
    own = per.select("folder", name.alias("name"), (name == baseline).alias("is_baseline"), "suffixes", first.alias("first"))
    return own.withColumn("suffix", F.when(F.col("is_baseline"), "__baseline").otherwise(F.col("first"))).drop("first")


def load(spark: SparkSession, root: str, baseline: str = "baseline", prefix: str = "PhaseAware") -> tuple[DataFrame, DataFrame]:
    """The archive as one row for each folder and pair, and `name, severity, problem` of what keeps a folder from being whole.

    The baseline has the results of its strategy that begins with `prefix`, an experiment its walk-forward differences. Where the
    files are there, both have the selector's own results, its comparison with the baseline, and the folder's summary;
    where not, NULL. All files are read in one scan; of rows of one pair in an optional file the last counts.
    """
    folders = materialise(_folders(spark, root, baseline))
    flat = materialise(manifests(spark, root))
    surface = flat.filter("problem is null").select(
        "folder", F.col("artifact_model").alias("architecture"), F.col("behavioral_surface").alias("representation"), F.coalesce("training_pair_family", F.lit("unknown")).alias("pair_family"),
        F.coalesce("behavioral_state", "surface_regime", F.lit("unknown")).alias("state"), F.coalesce("feature_surface", F.lit("unknown")).alias("feature_set"), F.coalesce("sentiment_surface", F.lit("unknown")).alias("sentiment_surface"),
    )
    pattern = rf"^({'|'.join(TABLES)})(__dl_enabled|__baseline)?\.csv$"
    read = read_by_name(spark, root, pattern).withColumns({"folder": folder_of(F.col("file")), "stem": F.regexp_extract(name_of(F.col("file")), pattern, 1), "ending": F.regexp_extract(name_of(F.col("file")), pattern, 2)})
    own = folders.select("folder", F.col("suffix").alias("ending"))
    rows = materialise(read.join(own, ["folder", "ending"], "left_semi"))

    def table(stem: str, shown: str = "", keys: tuple[str, ...] = ("folder", "pair"), last: bool = False) -> DataFrame:
        picked = rows.filter(F.col("stem") == stem).select("folder", typed_column("pair", "string").alias("pair"), F.struct("part", "place").alias("at"), *[typed_column(c, k).alias(f"{shown}{c}") for c, k in TABLES[stem].items()])
        if not last:
            return picked.drop("at")
        columns = [f"{shown}{c}" for c in TABLES[stem]]
        end = F.max_by if "pair" in keys else F.min_by
        return picked.groupBy(*keys).agg(end(F.struct(*columns), "at").alias("r")).select(*keys, "r.*")

    base = folders.filter("is_baseline").select("folder")
    other = folders.filter("not is_baseline").select("folder")
    results = table("results_per_pair").filter(F.col("strategy").startswith(prefix)).join(base, "folder", "left_semi")
    forward = table("walkforward_results_per_pair").join(other, "folder", "left_semi")
    both = results.unionByName(forward, allowMissingColumns=True)
    whole = folders.select("folder", "name", "is_baseline", "suffix").join(surface, "folder").join(both, "folder")
    for stem, shown in (("dynamic_selector_results_per_pair", "selector_"), ("baseline_vs_dynamic_comparison", "compared_")):
        whole = whole.join(table(stem, shown, last=True), ["folder", "pair"], "left")
    whole = whole.join(table("walkforward_results_summary", "summary_", ("folder",), last=True), "folder", "left")

    named = lambda df, severity, problem: df.select("name", F.lit(severity).alias("severity"), problem.alias("problem"))
    lacks = lambda there: folders.join(there.select("folder").distinct(), "folder", "left_anti")
    twice = results.groupBy("folder", "pair").agg(F.count("*").alias("n")).filter("n > 1").join(folders, "folder")
    problems = [
        named(lacks(surface), "error", F.lit("no single manifest")),
        named(folders.filter("suffix is null or (is_baseline and not array_contains(suffixes, '__baseline'))"), "error", F.lit("no results")),
        named(lacks(results).filter("is_baseline"), "error", F.lit(f"no {prefix} strategy")), named(lacks(forward).filter("not is_baseline"), "error", F.lit("no walk-forward results")),
        named(twice, "error", F.concat(F.lit(f"more than one {prefix} row: "), F.col("pair"))),
        named(folders.filter("is_baseline and array_contains(suffixes, '__dl_enabled')"), "warning", F.lit("a baseline with files of an experiment")),
        named(folders.filter("not is_baseline and suffix = '__baseline'"), "warning", F.lit("an experiment with files of a baseline")),
    ]
    return whole.drop("folder"), reduce(DataFrame.unionByName, problems)


def population_of(representation: Column, populations: dict[str, list[str]]) -> Column:
    """The pairs that a representation is judged by; NULL for one that is not known."""
    known = F.create_map(*[x for k, pairs in populations.items() for x in (F.lit(k), F.array(*map(F.lit, pairs)))])
    return F.try_element_at(known, representation)


def benchmark_problems(rows: DataFrame, populations: dict[str, list[str]] | None = None) -> DataFrame:
    """`section, severity, run_id, message`: folders whose pairs are not the baseline's, whose population is another or not known, or that
    lack a pair of theirs, and the architectures if there are several. Sets hold the pairs of one folder."""
    per = rows.groupBy(F.col("name").alias("run_id")).agg(
        F.any_value("is_baseline").alias("is_baseline"), F.any_value("architecture").alias("architecture"), F.any_value("representation").alias("representation"), F.array_sort(F.collect_set("pair")).alias("pairs")
    ).withColumn("population", F.array_sort(population_of(F.col("representation"), populations or POPULATIONS)))
    base = per.filter("is_baseline").agg(F.first("pairs").alias("base_pairs"), F.first("population").alias("base_population"))  # one row
    met = per.crossJoin(F.broadcast(base))
    joined = lambda a: F.array_join(a, ",")
    experiments = met.filter("not is_baseline")
    beyond = experiments.withColumns({"lacking": F.array_except("base_pairs", "pairs"), "extra": F.array_except("pairs", "base_pairs")}).filter("size(lacking) + size(extra) > 0")
    targets = met.withColumn("lacking", F.array_sort(F.array_except("population", "pairs"))).filter("size(lacking) > 0")
    several = experiments.agg(F.array_sort(F.collect_set("architecture")).alias("all")).filter("size(all) > 1").withColumn("run_id", F.lit("all"))
    return violations([
        ("universe", "error", beyond, F.concat(F.lit("lacks "), joined("lacking"), F.lit("; beyond "), joined("extra"))), ("architecture", "warning", several, joined("all")),
        ("population", "error", experiments.filter("not (population <=> base_population)"), F.coalesce("representation", F.lit("none"))), ("targets", "error", targets, joined("lacking")),
    ])
