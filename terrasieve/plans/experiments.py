"""Fold experiments: recipes and learners inside training folds only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, graph, guards, spatial
from . import learners, recipe, training


def out_of_fold(
    df: DataFrame,
    sets: dict[str, list[str]],
    recipes: Sequence[str],
    label: str,
    key: str,
    fold: str = "fold",
    learner: str = "boosted",
    trees: int | None = None,
    graph: Sequence[str] = (),
    threshold: float = 0.30,
    buffer_km: float = 0.0,
) -> DataFrame:
    """Predictions of every row by models that did not see its fold: (model,
    fold, key, y, p). Columns are chosen, imputed, residualised and scaled on
    the training rows of each fold; with ``buffer_km``, training rows near a
    test row are left out (columns lat, lon)."""
    parts = []
    for f in training.fold_names(df, fold):
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        train = spatial.remove_buffer(train, test, key, buffer_km)
        if train.select(label).distinct().count() < 2:
            continue
        for name in recipes:
            made = recipe.make_recipe(name, train, sets, graph, threshold).fit(train)
            model = learners.fit(made.transform(train), made.output_columns, label, learner, trees=trees)
            scored = learners.score(model, made.transform(test), made.output_columns, [key, label, fold])
            parts.append(scored.select(F.lit(name).alias("model"), F.col(fold).alias("fold"), F.col(key).alias(key), F.col(label).cast("int").alias("y"), "p"))
    return guards.union_all(parts)


def baselines(df: DataFrame, features: Sequence[str], label: str, key: str, names: Sequence[str] = ("dummy", "logistic_l2", "hist_boosted", "forest"), fold: str = "fold", trees: int | None = None) -> DataFrame:
    """Metrics of plain learners by fold: (model, fold, ...). The dummy draws
    1 with the training rate."""
    parts = []
    for f in training.fold_names(df, fold):
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        rate = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        if rate is None or not 0 < rate < 1:
            continue
        for name in names:
            if name == "dummy":
                out = learners.dummy_scores(test, float(rate), [key, label, fold], key)
            else:
                out = learners.score(learners.fit(train, features, label, name, trees=trees), test, features, [key, label, fold])
            parts.append(out.select(F.lit(name).alias("model"), F.col(fold).alias("fold"), F.col(label).cast("int").alias("y"), "p"))
    return evaluate.classification_metrics(guards.union_all(parts), ["model", "fold"])


def fold_report(oof: DataFrame, key: str) -> dict[str, DataFrame]:
    """Metrics by fold, their means, and pooled metrics (another estimand)."""
    folds = evaluate.classification_metrics(oof, ["model", "fold"])
    return {
        "folds": folds,
        "mean_of_folds": evaluate.summarize(folds, ["model"], ["roc_auc", "average_precision", "f1"]),
        "pooled": evaluate.classification_metrics(oof, ["model"]),
        "top": evaluate.top_wide(evaluate.top_metrics(oof, ["model", "fold"], order=key), ["model", "fold"]),
    }


def coverage(oof: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """For each model: rows predicted, different keys, and keys missing."""
    total = rows.select(key).distinct().count()
    return oof.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("n_missing", F.lit(total) - F.col("n_keys"))


def discover_edges(df: DataFrame, env: str, label: str, columns: Sequence[str], groups: dict[str, str], most: int = 45, sparse: bool = True) -> DataFrame:
    """Edges of each environment: partial correlations of all pairs, and the
    columns that a sparse logistic model of the label selects. Environments
    are a bounded catalogue."""
    names, chosen = [*columns, label], {}
    for value in training.fold_names(df, env) if sparse else []:
        part = df.where(F.col(env).eqNullSafe(F.lit(value)))
        if part.select(label).distinct().count() == 2:
            chosen[value] = set(learners.l1_selected(learners.fit(part, columns, label, "logistic_l1"), columns))
    rows = [
        (str(e), a, b, groups.get(a, "unknown"), groups.get(b, "unknown"), r, p, ok, b == label and a in chosen.get(e, ()))
        for e, a, b, r, p, ok in graph.partial_edges(df, env, names)
    ]
    schema = "environment string, a string, b string, group_a string, group_b string, partial_corr double, partial_p double, selected_by_partial_corr boolean, selected_by_target_logistic boolean"
    return graph.strongest_edges(graph.orient(df.sparkSession.createDataFrame(rows, schema)), most)
