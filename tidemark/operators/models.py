"""Classifiers as ML pipelines: fitted on training rows only, applied in one distributed pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.windows import with_position


def features(columns: list[str], scaled: bool = True) -> list:
    """Stages that gather columns into a vector, scaled by the training rows' mean and deviation."""
    gather = VectorAssembler(inputCols=columns, outputCol="raw" if scaled else "features", handleInvalid="skip")
    return [gather, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scaled else [gather]


def fit_direction(train: DataFrame, columns: list[str], label: str, learner: str = "logistic", seed: int = 42) -> PipelineModel:
    """A binary label by a logistic regression, a random `forest`, or `boosted` trees."""
    learners = {
        "logistic": LogisticRegression(labelCol=label, maxIter=20), "forest": RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=4, seed=seed),
        "boosted": GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=seed),
    }
    return Pipeline(stages=[*features(columns, scaled=learner == "logistic"), learners[learner]]).fit(train)


def fit_types(train: DataFrame, columns: list[str], label: str, seed: int = 42) -> PipelineModel:
    """Random forest of a text label; classes are numbered by name, so the numbering does not depend on counts."""
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    forest = RandomForestClassifier(labelCol="label_index", numTrees=20, maxDepth=4, seed=seed)
    return Pipeline(stages=[index, *features(columns, scaled=False), forest]).fit(train)


def with_probabilities(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a probability column for each class."""
    p = vector_to_array("probability")
    return model.transform(rows).withColumns({f"p_{n}": p[i] for i, n in enumerate(names)}).drop("raw", "features", "rawPrediction", "probability")


def importances(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """Importance of each feature in the order it was fitted."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(columns, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def accuracy(scored: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of right predictions."""
    return scored.groupBy(*keys).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def cross_validated(rows: DataFrame, columns: list[str], label: str, splits: int = 5, learner: str = "logistic") -> DataFrame:
    """`fold, accuracy, n, accuracy_mean, accuracy_std`: a direction model for each fold, learned from all parts before it.

    The number of fits is `splits`, whatever the table's size; a fold whose training rows have one class only is left out.
    """
    parts = rows.dropna(subset=[*columns, label]).withColumn("part", F.ntile(splits + 1).over(Window.partitionBy("pair").orderBy("ts")))
    classes = parts.groupBy("part").agg(F.min(label).alias("low"), F.max(label).alias("high")).orderBy("part").collect()
    scored = None
    for k in range(2, splits + 2):
        before = [r for r in classes if r["part"] < k]
        if not before or min(r["low"] for r in before) == max(r["high"] for r in before):
            continue
        one = fit_direction(parts.filter(F.col("part") < k), columns, label, learner).transform(parts.filter(F.col("part") == k)).select(F.lit(k - 1).alias("fold"), "prediction", label)
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        return rows.sparkSession.createDataFrame([], "fold int, accuracy double, n long, accuracy_mean double, accuracy_std double")
    every = Window.partitionBy()
    folds = accuracy(scored, ["fold"], label)  # as many rows as splits
    return folds.withColumns({"accuracy_mean": F.avg("accuracy").over(every), "accuracy_std": F.stddev_pop("accuracy").over(every)})


def direction_variants(rows: DataFrame, columns: list[str], phases: list[str], label: str, least: int = 100, splits: int = 5, learner: str = "logistic") -> DataFrame:
    """`variant, phase, accuracy_mean, accuracy_std, n`: without phases, with phases as features, and a model for each phase of `least` rows."""
    from tidemark.functions.expr import one_hot

    counts = {r["phase"]: r["n"] for r in rows.dropna(subset=[*columns, label]).groupBy("phase").agg(F.count("*").alias("n")).collect()}
    hot = one_hot(rows, "phase", phases)
    runs = [("none", None, rows, columns), ("phase_feature", None, hot, [*columns, *[f"phase_{p}" for p in phases]])]
    runs += [("per_phase", p, rows.filter(F.col("phase") == p), columns) for p in phases if counts.get(p, 0) >= least]
    out = None
    for variant, phase, part, features_ in runs:
        one = cross_validated(part, features_, label, splits, learner).groupBy().agg(F.first("accuracy_mean").alias("accuracy_mean"), F.first("accuracy_std").alias("accuracy_std"), F.sum("n").alias("n"))
        one = one.select(F.lit(variant).alias("variant"), F.lit(phase).cast("string").alias("phase"), "accuracy_mean", "accuracy_std", "n")
        out = one if out is None else out.unionByName(one)
    return out


def compared_variants(variants: DataFrame) -> DataFrame:
    """`variant, accuracy, n, difference`: each variant's accuracy, that of phases weighted by their rows, and how much it differs from no phases'."""
    known = variants.filter("accuracy_mean is not null")
    means = known.groupBy("variant").agg((F.sum(F.col("accuracy_mean") * F.col("n")) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    base = means.filter("variant = 'none'").select(F.col("accuracy").alias("__base"))  # one row at most
    return means.join(F.broadcast(base), F.lit(True), "left").withColumn("difference", F.col("accuracy") - F.col("__base")).drop("__base")


def softmax_weights(x: np.ndarray, y: np.ndarray, n_classes: int, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (with a constant last) of a multinomial logistic regression, by gradient steps with a step size that cannot overshoot."""
    x = np.c_[x, np.ones(len(x))]
    wanted = np.eye(n_classes)[y]
    w = np.zeros((x.shape[1], n_classes))
    rate = 1 / (np.linalg.norm(x, 2) ** 2 / 2 + ridge)
    for _ in range(steps):
        w -= rate * (x.T @ (_shares(x @ w) - wanted) + ridge * w)
    return w


def _shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def next_phases(train_x: np.ndarray, train_y: np.ndarray, x: np.ndarray, n_classes: int) -> np.ndarray:
    """Predicted classes: scaled by the training rows' mean and deviation; a class that they lack is added with their last row."""
    mean, deviation = train_x.mean(axis=0), train_x.std(axis=0)
    deviation[deviation == 0] = 1
    missing = sorted(set(range(n_classes)) - set(train_y.tolist()))
    train_x = np.concatenate([train_x, np.repeat(train_x[-1:], len(missing), axis=0)])
    w = softmax_weights((train_x - mean) / deviation, np.concatenate([train_y, np.array(missing, int)]), n_classes)
    return (np.c_[(x - mean) / deviation, np.ones(len(x))] @ w).argmax(axis=1)


def walk_forward_phases(rows: DataFrame, columns: list[str], phases: list[str], window: int = 504, every: int = 63, least: int = 50) -> DataFrame:
    """`pair, ts, phase, predicted, learned`: the next bar's phase, by a model fitted on the `window` bars before each `every`-th bar.

    A row goes by arithmetic to the fits whose window holds it, and to the one that predicts it; a pair and fit is a
    group of `window + every` rows at most, so fits run in parallel whatever the number of pairs. Rows before the first
    fit, rows without features, and fits on fewer than `least` rows keep the rule: the phase stays as it is.
    """
    by = Window.partitionBy("pair").orderBy("ts")
    number = F.array_position(F.array(*map(F.lit, phases)), F.col("next")) - 1
    placed = with_position(rows).withColumn("next", F.lead("phase").over(by)).withColumn("next_number", F.when(F.col("next").isNotNull(), number))
    own = F.floor((F.col("pos") - window) / every)
    # trained on by the fits k with window + k * every - window <= pos < window + k * every
    first, last = F.greatest(own + 1, F.lit(0)), F.floor(F.col("pos") / every)
    uses = F.concat(F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("fit"), F.lit(True).alias("train"))), F.when(own >= 0, F.array(F.struct(own.alias("fit"), F.lit(False).alias("train")))).otherwise(F.array()))
    dealt = placed.dropna(subset=columns).select("pair", "ts", "pos", "next_number", *columns, F.explode(F.when(first <= last, uses).otherwise(F.slice(uses, -1, 1))).alias("u")).select("*", "u.fit", "u.train").drop("u")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        train, asked = part[part["train"] & part["next_number"].notna()], part[~part["train"]]
        if len(train) < least or not len(asked):
            return asked[["pair", "ts"]].iloc[:0].assign(number=pd.Series(dtype="int64"))
        found = next_phases(train[columns].to_numpy(float), train["next_number"].to_numpy(int), asked[columns].to_numpy(float), len(phases))
        return pd.DataFrame({"pair": asked["pair"], "ts": asked["ts"], "number": found})

    made = dealt.groupBy("pair", "fit").applyInPandas(fit, f"pair string, ts {dict(rows.dtypes)['ts']}, number long")
    joined = placed.join(made, ["pair", "ts"], "left")
    predicted = F.coalesce(F.try_element_at(F.array(*map(F.lit, phases)), (F.col("number") + 1).cast("int")), F.col("phase"))
    return joined.select("pair", "ts", "phase", "next", predicted.alias("predicted"), F.col("number").isNotNull().alias("learned"))


class TypeSelector:
    """A selector of strategy types with a frozen schema: its columns and classes are those it was trained with."""

    def __init__(self, model: PipelineModel, columns: list[str], classes: list[str]):
        self.model, self.columns, self.classes = model, columns, classes

    @classmethod
    def train(cls, rows: DataFrame, columns: list[str], label: str, least: int = 100, seed: int = 42) -> TypeSelector | None:
        """Fitted on the rows that have all features; none if these are fewer than `least`."""
        whole = rows.dropna(subset=[*columns, label])
        if whole.limit(least).count() < least:
            return None
        model = fit_types(whole, columns, label, seed)
        return cls(model, list(columns), list(model.stages[0].labels))

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """`rows` that have all features, with `p_<class>` and `selected`; a table without one of the columns is refused."""
        if missing := [c for c in self.columns if c not in rows.columns]:
            raise ValueError(f"the selector was trained with columns that are not here: {missing}")
        scored = with_probabilities(self.model, rows.dropna(subset=self.columns), self.classes)
        return scored.withColumn("selected", F.element_at(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int") + 1))


def dealt_folds(rows: DataFrame, label: str, folds: int, seed: int = 42, keys: tuple[str, ...] = ("pair", "ts"), bits: int = 12) -> DataFrame:
    """`rows` with `fold`: each class numbered in the order of a hash and dealt out, so its folds differ by one row at most.

    The hash's first `bits` cut each class into ranges; ranges are counted, and numbered inside from where they start. No class
    is sorted by one task.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(F.lit(seed), *keys)).withColumn("__range", F.shiftright("__hash", 64 - bits))
    counts = hashed.groupBy(label, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(label).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(label).alias("__label"), F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(label, "__range").orderBy("__hash", *keys)) - 1
    met = hashed.withColumn("__place", inside).join(starts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__of")))
    return met.withColumn("fold", F.pmod(F.col("__start") + F.col("__place"), F.lit(folds)).cast("int")).drop("__hash", "__range", "__place", "__label", "__of", "__start")


def stratified_accuracy(rows: DataFrame, columns: list[str], label: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """`fold, accuracy, n`: each class dealt out evenly over the folds (`dealt_folds`); a model for each fold."""
    whole = rows.dropna(subset=[*columns, label])
    dealt = dealt_folds(whole, label, folds, seed)
    scored = None
    for k in range(folds):
        s = TypeSelector(model := fit_types(dealt.filter(F.col("fold") != k), columns, label, seed), columns, list(model.stages[0].labels))
        one = s.probabilities(dealt.filter(F.col("fold") == k)).select("fold", (F.col("selected") == F.col(label)).cast("double").alias("right"))
        scored = one if scored is None else scored.unionByName(one)
    return scored.groupBy("fold").agg(F.avg("right").alias("accuracy"), F.count("*").alias("n"))


def yearly_experiments(rows: DataFrame, sets: dict[str, list[str]], label: str, outcome: str) -> DataFrame:
    """`year, experiment, accuracy, mean_return, hit_rate, sharpe, n_trades`: for each year that has years before it, and each feature set.

    A trade is a row predicted up; its return is `outcome`. The fits are as many as years and sets.
    """
    dated = rows.withColumn("year", F.year("ts"))
    years = sorted(r["year"] for r in dated.select("year").distinct().collect())
    out = None
    for name, columns in sorted(sets.items()):
        whole = dated.dropna(subset=[*columns, label])
        for year in years[1:]:
            train = whole.filter(F.col("year") < year)
            if train.select(label).distinct().limit(2).count() < 2:
                continue
            one = fit_direction(train, columns, label).transform(whole.filter(F.col("year") == year)).select("year", F.lit(name).alias("experiment"), "prediction", label, outcome)
            out = one if out is None else out.unionByName(one)
    traded = F.when(F.col("prediction") == 1, F.col(outcome))
    return out.groupBy("year", "experiment").agg(
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), F.avg(traded).alias("mean_return"), F.avg((traded > 0).cast("double")).alias("hit_rate"),
        (F.avg(traded) / F.nullif(F.stddev_samp(traded), F.lit(0.0))).alias("sharpe"), F.count(traded).alias("n_trades"),
    )
