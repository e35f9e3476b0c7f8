"""Manifests of experiment runs: JSON of several generations, read as VARIANT and laid flat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import violations
from tidemark.sources.delimited import folder_of, logical_path, name_of

# How a manifest's file is named, the word in a name that tells awareness, and what blocks hold.
MANIFEST_FILE = r"^run_manifest(_.*)?\.json$"
AWARENESS = r"(?:^|[_\-/])(aware|blind)(?:$|[_\-/])"
SENTIMENT_SURFACES = ("sentiment", "no_sentiment", "none")
SEEDS = ("experiment_seed", "numpy_seed", "python_random_seed", "torch_seed")
ORDER_SECTIONS = ("phase_predictor_by_pair", "strategy_selector_by_pair")
GENERATIONS, VARIANTS = ("gen1", "gen2"), ("A", "B", "C", "D", "E", "F")
NAMED = r"^(gen[12])_([A-F])__(\d{8}T\d{6}Z)"


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, path: str) -> Column:
    """What is at a path: STRING, BOOLEAN, BIGINT, OBJECT<...>, VOID for a JSON null, NULL where nothing is."""
    return F.schema_of_variant(_part(v, path))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit("")))


def _flag(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _whole(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).isin("BIGINT", "STRING"), F.try_variant_get(v, path, "string").try_cast("bigint"))


def _block(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).startswith("OBJECT"), F.to_json(_part(v, path)))


def awareness(name: Column) -> Column:
    """True or False if a name holds only the word `aware`, or only `blind`, between marks; else NULL."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.trim(name)), F.lit(AWARENESS), F.lit(1)))
    return F.when(words == F.array(F.lit("aware")), True).when(words == F.array(F.lit("blind")), False)


def _factor(v: Column, name: str, default: bool, older: str | None = None) -> Column:
    """A flag of the factors, in older manifests of the experiment itself; what is no flag is the default."""
    own = f"$.experiment.factors.{name}"
    value = F.when(_part(v, own).isNotNull(), _flag(v, own))
    return F.coalesce(value.otherwise(_flag(v, older)) if older else value, F.lit(default))


def raw_manifests(spark: SparkSession, root: str) -> DataFrame:
    """`folder, file, v`: every manifest below `root` as VARIANT, NULL where it is no JSON. Other files are not opened."""
    path = logical_path(F.col("_metadata.file_path"))
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root).filter(name_of(path).rlike(MANIFEST_FILE))
    return raw.select(folder_of(path).alias("folder"), name_of(path).alias("file"), F.try_parse_json("value").alias("v"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One flat row per manifest. What a manifest lacks is NULL, but factors have defaults; `problem` tells why a row counts for nothing.

    Awareness in the folder's name or in the run's id outweighs the factor. `surface_source` is the surface's own one; without
    it, a manifest of the older kind (marked so, or without generation or variant) falls back, and another one lacks its surface.
    """
    raw = raw_manifests(spark, root)
    v, folder = F.col("v"), F.col("folder")
    name = F.regexp_extract(folder, "([^/=]+)$", 1)
    run_id, top_id = _text(v, "$.run.run_id"), _text(v, "$.run_id")
    generation, variant = _text(v, "$.experiment.generation"), _text(v, "$.experiment.variant")
    block = _kind(v, "$.experiment")
    broken = block.isNotNull() & ~block.startswith("OBJECT") & (block != "VOID")
    marked = F.coalesce(_flag(v, "$.experiment.legacy_semantics"), F.lit(False))
    older = broken | marked | generation.isNull() | variant.isNull()
    regime = "$.experiment.factors.msml_regime"
    factors = {
        "dl_factor": _factor(v, "dl_enabled", True, "$.experiment.dl_enabled"),
        "sentiment_enabled": _factor(v, "sentiment_enabled", True, "$.experiment.sentiment_enabled"),
        "missing_indicators_enabled": F.coalesce(awareness(name), awareness(run_id), awareness(top_id), _factor(v, "missing_indicators_enabled", False, "$.experiment.missing_indicators_enabled")),
        "msml_regime": F.coalesce(F.upper(F.when(_part(v, regime).isNotNull(), _text(v, regime)).otherwise(_text(v, "$.experiment.msml_regime"))), F.lit("LVTF")),
        "overlap_only": _factor(v, "overlap_only", False), "selector_enabled": _factor(v, "selector_enabled", True),
    }
    surface = "$.experiment_surface."
    sentiment = F.lower(_text(v, f"{surface}sentiment_surface"))
    flat = raw.select(
        "folder", "file", name.alias("name"), F.coalesce(run_id, top_id).alias("run_id"), *[_text(v, f"$.run.{c}").alias(c) for c in ("git_sha", "timestamp_utc", "python_version")],
        generation.alias("generation"), variant.alias("variant"), *[_text(v, f"$.experiment.{c}").alias(c) for c in ("run_family", "semantic_label")], _whole(v, "$.experiment.semantics_version").alias("semantics_version"),
        marked.alias("legacy_semantics"), *[F.when(v.isNotNull() & ~F.coalesce(broken, F.lit(False)), c).alias(k) for k, c in factors.items()], _flag(v, "$.dl.dl_enabled").alias("dl_own"),
        *[_text(v, f"$.dl.{c}").alias(c) for c in ("dl_surface", "dl_surface_string", "dl_artifact_path", "dl_mode_tag")], *[_block(v, f"$.{c}").alias(c) for c in ("walkforward", "flags", "reproducibility", "feature_ordering")],
        F.when(v.isNotNull(), F.coalesce(_text(v, f"{surface}surface_source"), F.when(older, "legacy_variant_fallback").otherwise("missing_experiment_surface"))).alias("surface_source"),
        F.when(sentiment.isin(*SENTIMENT_SURFACES), sentiment).otherwise(F.when(_flag(v, f"{surface}sentiment_surface"), "sentiment").when(~_flag(v, f"{surface}sentiment_surface"), "no_sentiment")).alias("sentiment_surface"),
        *[_text(v, f"{surface}{c}").alias(c) for c in ("training_pair_family", "evaluation_pair_family", "feature_surface", "artifact_source", "artifact_model", "behavioral_surface", "behavioral_state")],
        _text(v, f"{surface}msml_regime").alias("surface_regime"), _whole(v, f"{surface}surface_semantics_version").alias("surface_semantics_version"),
        *[_whole(v, f"$.reproducibility.{c}").alias(c) for c in SEEDS], *[F.try_variant_get(v, f"$.feature_ordering.{s}", "map<string,array<string>>").alias(f"order_{s}") for s in ORDER_SECTIONS], v.isNull().alias("no_json"),
    )
    counts = flat.groupBy("folder").agg(F.count("*").alias("n_manifests"))
    problem = F.when(F.col("no_json"), "not JSON").when(F.col("n_manifests") > 1, "several manifests in a folder")
    return flat.join(counts, "folder").withColumn("dl_enabled", F.coalesce("dl_own", "dl_factor")).withColumn("problem", problem).drop("dl_own", "dl_factor", "no_json")


def archive_problems(folders: DataFrame, flat: DataFrame) -> DataFrame:
    """`section, severity, run_id, message` of all that is wrong with an archive, from its folders (`discover`) and its flat manifests.

    Runs are named by their folder. Rules over several runs group by what they share and name that.
    """
    roots = folders.filter((F.col("manifests") > 0) | (F.col("csvs") > 0)).withColumn("run_id", F.regexp_extract("folder", "([^/=]+)$", 1))
    flat = flat.join(folders.select("folder"), "folder", "left_semi")
    one = flat.filter("problem is null")
    named = lambda k: F.nullif(F.regexp_extract("name", NAMED, k), F.lit(""))
    runs = one.select(
        F.col("name").alias("run"), F.col("run_id").alias("manifest_run_id"), "generation", "variant", "timestamp_utc", named(1).alias("named_generation"), named(2).alias("named_variant"), named(3).alias("named_time"),
        (F.col("generation").isin(*GENERATIONS) & F.col("variant").isin(*VARIANTS) & ~F.col("legacy_semantics")).alias("canonical"), "sentiment_enabled", "surface_source", "surface_semantics_version", "sentiment_surface",
        "experiment_seed", F.coalesce("feature_surface", F.lit("unknown")).alias("surface"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in SEEDS]).alias("seeds"),
        F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in SEEDS]), lambda c: c.isNotNull()).alias("no_seeds"), *[f"order_{c}" for c in ORDER_SECTIONS],
    )
    time = F.coalesce("timestamp_utc", "named_time")
    runs = runs.withColumn("semantic_id", F.when(F.col("generation").isNotNull() & F.col("variant").isNotNull(), F.concat_ws("__", F.concat_ws("_", "generation", "variant"), time)))
    group = F.concat_ws("::", F.col("experiment_seed").cast("string"), "surface")

    def twice(df: DataFrame, key: Column) -> DataFrame:
        return df.groupBy(key.alias("run_id")).agg(F.count("*").alias("n")).filter("n > 1 and run_id is not null")

    def drift(ours: str, named_column: str) -> DataFrame:
        return runs.filter(F.col(ours) != F.col(named_column)).withColumnRenamed("run", "run_id")

    stands = F.concat(F.lit("stands "), F.col("n").cast("string"), F.lit(" times"))
    by_pair = [runs.filter("experiment_seed is not null").select(group.alias("run_id"), F.lit(c).alias("section"), F.explode(f"order_{c}").alias("pair", "columns")) for c in ORDER_SECTIONS]
    orders = reduce(DataFrame.unionByName, by_pair).groupBy("run_id", "section", "pair").agg(F.countDistinct(F.sha2(F.to_json("columns"), 256)).alias("n")).filter("n > 1")
    seeds = runs.filter("experiment_seed is not null").groupBy(group.alias("run_id")).agg(F.countDistinct("seeds").alias("n")).filter("n > 1")
    whole_surface = F.col("surface_semantics_version").isNotNull() & F.col("sentiment_surface").isNotNull()
    return violations([
        ("provenance", "error", twice(roots, F.col("run_id")), F.concat(F.lit("run id "), stands)),
        ("provenance", "error", twice(runs, F.col("semantic_id")), F.concat(F.lit("semantic id "), stands)),
        ("reproducibility", "warning", twice(runs, F.col("manifest_run_id")), F.concat(F.lit("manifest id "), stands)),
        ("manifest", "error", roots.filter("manifests > 1"), F.concat(F.col("manifests").cast("string"), F.lit(" manifests"))),
        ("manifest", "warning", roots.filter("manifests = 0"), F.lit("no manifest")),
        ("manifest", "error", flat.filter("problem = 'not JSON'").drop("run_id").withColumnRenamed("name", "run_id"), F.lit("not JSON")),
        ("manifest", "error", drift("timestamp_utc", "named_time"), F.concat(F.lit("time "), F.col("timestamp_utc"), F.lit(" is not that of the name"))),
        ("semantic", "error", drift("generation", "named_generation"), F.concat(F.lit("generation "), F.col("generation"), F.lit(" is not that of the name"))),
        ("semantic", "error", drift("variant", "named_variant"), F.concat(F.lit("variant "), F.col("variant"), F.lit(" is not that of the name"))),
        ("semantic", "error", runs.filter(F.col("canonical") & ~whole_surface).withColumnRenamed("run", "run_id"), F.lit("no experiment surface")),
        ("semantic", "warning", twice(runs.filter("canonical"), F.concat_ws("_", "generation", "variant")), F.concat(F.lit("cohort "), stands)),
        ("reproducibility", "warning", runs.filter(F.size("no_seeds") > 0).withColumnRenamed("run", "run_id"), F.concat(F.lit("no "), F.concat_ws(", ", "no_seeds"))),
        ("reproducibility", "warning", seeds, F.lit("equal seed and surface, other seeds")),
        ("reproducibility", "warning", orders, F.concat(F.lit("equal seed and surface, other column order: "), F.col("section"), F.lit(":"), F.col("pair"))),
    ])
