"""Result tables written as partitioned Parquet, with CSV on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of evaluations and recommendations, and the version that an evaluation's identifier holds.
EVALUATIONS = [
    "evaluation_id", "surface_id", "surface_version", "state_id", "strategy_id", "expected_return", "expected_sharpe", "expected_drawdown",
    "win_rate", "confidence", "stability", "n_folds", "n_trades", "metadata",
]
EVALUATION_VERSION = RECOMMENDATION_VERSION = "1.0.0"
RECOMMENDATIONS = ["recommendation_id", "evaluation_id", "rank", "recommendation_policy", "metadata"]


def write_results(df: DataFrame, path: str, mode: str, csv: bool = False) -> None:
    """A result table of one mode; other modes' partitions stay."""
    tagged = df.withColumn("mode", F.lit(mode))
    if csv:
        tagged.write.mode("append").option("header", True).csv(f"{path}__{mode}")
    else:
        tagged.write.mode("append").partitionBy("mode").parquet(path)


def evaluation_records(evaluations: DataFrame, surface_id: str, surface_version: str, state_id: str, experiment_id: str) -> DataFrame:
    """Evaluations in their 14 columns: measures that are absent are NULL, the identifier follows from what was evaluated, and further columns are metadata."""
    fixed = {"surface_id": surface_id, "surface_version": surface_version, "state_id": state_id}
    named = {"experiment_id": F.lit(experiment_id), "schema_version": F.lit(EVALUATION_VERSION), "strategy_id": F.col("strategy_id"), **{k: F.lit(v) for k, v in fixed.items()}}
    digest = F.sha2(F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)])), 256)
    rows = evaluations.withColumns({"evaluation_id": F.concat(F.lit("eval_"), F.substring(digest, 1, 24)), **{k: F.lit(v) for k, v in fixed.items()}})
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("expected_drawdown", "win_rate", "confidence", "stability") if c not in rows.columns})
    more = sorted(c for c in evaluations.columns if c not in EVALUATIONS)
    return rows.withColumn("metadata", F.to_json(F.struct(*more)) if more else F.lit("{}")).select(*EVALUATIONS)


def write_evaluations(records: DataFrame, path: str) -> None:
    """Evaluations in their 14 columns, ordered by surface, state and strategy."""
    by = ["surface_id", "state_id", "strategy_id"]
    records.select(*EVALUATIONS).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def recommendation_records(ranked: DataFrame, policy: str = "sharpe") -> DataFrame:
    """Ranked evaluation records as recommendations: each names its evaluation, and its identifier follows from that, the policy and the rank."""
    said = {"evaluation_id": F.col("evaluation_id"), "rank": F.col("rank"), "recommendation_policy": F.lit(policy), "schema_version": F.lit(RECOMMENDATION_VERSION)}
    digest = F.sha2(F.to_json(F.struct(*[said[k].alias(k) for k in sorted(said)])), 256)
    named = ranked.withColumns({"recommendation_policy": said["recommendation_policy"], "recommendation_id": F.concat(F.lit("rec_"), F.substring(digest, 1, 24))})
    return named.withColumn("metadata", F.to_json(F.struct(said["schema_version"].alias("schema_version")))).select(*RECOMMENDATIONS)


def write_recommendations(ranked: DataFrame, path: str, policy: str = "sharpe") -> None:
    """Recommendations by rank, of evaluation records with `rank`."""
    recommendation_records(ranked, policy).select(*RECOMMENDATIONS).sortWithinPartitions("rank").write.mode("overwrite").parquet(path)


def write_phase_labels(labels: DataFrame, gaps: DataFrame, path: str) -> None:
    """Phase labels as Parquet, and the gaps beside them as CSV."""
    labels.write.mode("overwrite").partitionBy("pair").parquet(f"{path}/labels")
    gaps.write.mode("overwrite").option("header", True).csv(f"{path}/gaps")
