"""Learners of ``pyspark.ml`` behind one call: fit on a frame, score a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import guards, neighbours
from ..operators.guards import ContractError


def class_weights(df: DataFrame, label: str, kind: str) -> dict[int, float]:
    """``balanced``: n / (2 n_class); ``ratio``: positives weigh neg / pos."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    p, n = r["p"], r["n"]
    if not p or not n:
        raise ContractError("training rows of one class only")
    return {1: n / p, 0: 1.0} if kind == "ratio" else {1: (p + n) / (2 * p), 0: (p + n) / (2 * n)}


#: Inverse strengths of the penalties of the linear learners.
STRENGTH = {"logistic_l2": 1.0, "logistic_l1": 0.25}


def estimator(name: str, seed: int, trees: int | None = None, rows: int = 1):
    """A learner by name. The penalty of a linear one is 1 / (C rows): weights
    are balanced, so they sum to the rows, and a mean loss is what is
    penalised here."""
    common = {"featuresCol": "features", "labelCol": "_y", "weightCol": "_w"}
    if name == "boosted":
        return GBTClassifier(**common, maxIter=trees or 400, stepSize=0.03, maxDepth=3, subsamplingRate=0.85, seed=seed)
    if name == "forest":
        return RandomForestClassifier(**common, numTrees=trees or 300, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed)
    if name == "logistic_l2":
        return LogisticRegression(**common, regParam=1 / (STRENGTH[name] * max(rows, 1)), elasticNetParam=0.0, maxIter=100, standardization=False)
    if name == "logistic_l1":
        return LogisticRegression(**common, regParam=1 / (STRENGTH[name] * max(rows, 1)), elasticNetParam=1.0, maxIter=100, standardization=False)
    if name == "hist_boosted":
        return GBTClassifier(**common, maxIter=trees or 200, stepSize=0.05, maxDepth=4, seed=seed)
    raise ValueError(f"unknown learner {name}")


def fit(train: DataFrame, features: Sequence[str], label: str, learner: str = "boosted", seed: int = 20260622, trees: int | None = None):
    """A fitted pipeline: median imputation, assembly, scaling for the linear
    learners, and the learner with class weights of the training rows."""
    weights = class_weights(train, label, "ratio" if learner in ("boosted", "hist_boosted") else "balanced")
    data = train.withColumns(
        {"_y": F.col(label).cast("double"), "_w": F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]), **{c: F.col(c).cast("double") for c in features}}
    )
    filled = [f"_f_{c}" for c in features]
    linear = learner.startswith("logistic")
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw" if linear else "features")]
    if linear:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator(learner, seed, trees, data.count() if linear else 1)]).fit(data)


def score(model, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    data = df.withColumns({c: F.col(c).cast("double") for c in features})
    return model.transform(data).select(*keep, vector_to_array("probability")[1].alias("p"))


def dummy_scores(df: DataFrame, rate: float, keep: Sequence[str], key: str) -> DataFrame:
    """A stratified dummy: 1 with the training rate, by a hash of the key."""
    u = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003
    return df.select(*keep, (u < rate).cast("double").alias("p"))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))


def smote_like(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """The minority class filled up to balance by points between a row and one
    of its ``k`` nearest of the class (distance on scaled features).

    New rows have a null key and are dealt evenly over the rows of the class.
    Rows with equal features count as one neighbour; a row without any
    neighbour is repeated. Rows with a null feature are kept but not used, and
    rows without a label fill no class."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    kept = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features])
    small = min(counts, key=lambda c: (counts[c], c), default=None)
    need = max(counts.values(), default=0) - counts.get(small, 0)
    rows = settled(kept.where(F.col(label) == small).dropna(subset=list(features)).select(F.col(key).alias("_k"), F.array(*features).alias("_a")))
    n = rows.count()
    if not need or not n:
        return kept
    spread = rows.agg(*[F.stddev_pop(F.col("_a")[i]).alias(c) for i, c in enumerate(features)]).first()
    values = settled(rows.groupBy("_a").agg(F.min("_k").alias("_rep")))
    near = neighbours.k_nearest(values, "_rep", "_a", k, [spread[c] for c in features])
    lists = near.groupBy("_rep").agg(F.sort_array(F.collect_list(F.struct("nth", "near_vector"))).alias("_near"))
    numbered = guards.with_row_index(rows, ["_k"], "_nth")
    times = F.lit(need // n) + (F.col("_nth") < need % n).cast("long")
    made = numbered.withColumn("_times", times).where("_times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    made = made.join(values.join(lists, "_rep", "left"), "_a")
    h = lambda salt: F.pmod(F.xxhash64("_k", "_i", F.lit(seed), F.lit(salt)), F.lit(1_000_003))
    pick = F.coalesce(F.get("_near", (h(1) % F.size("_near")).cast("int"))["near_vector"], F.col("_a"))
    made = made.withColumn("_x", F.zip_with("_a", pick, lambda x, y: x + (y - x) * (h(2) / 1_000_003)))
    new = made.select(F.lit(None).cast(dict(df.dtypes)[key]).alias(key), F.lit(small).alias(label), *[F.col("_x")[i].alias(c) for i, c in enumerate(features)])
    return kept.unionByName(new)


def l1_selected(model, features: Sequence[str], floor: float = 1e-9) -> list[str]:
    """Features that a sparse logistic model gives a coefficient."""
    return [f for f, c in zip(features, model.stages[-1].coefficients.toArray()) if abs(c) > floor]
