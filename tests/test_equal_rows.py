"""Rows of equal columns and equal models are scored once, with the same figures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrasieve.operators import evaluate
from terrasieve.plans import linear


@pytest.fixture(scope="module")
def fitted(spark):
    i = F.col("id")
    rows = spark.range(400).select((i % 4).cast("int").alias("fold"), (i % 97).alias("k"), (i * 7 % 5 > 2).cast("int").alias("y"), F.when(i % 6 != 0, (i * 13 % 20).cast("double")).alias("a"), (i % 3).cast("double").alias("c"))
    models = linear.fit_folds(rows, ["a", "c"], "y")
    for f in models.grams:
        for name in ("one", "same"):
            models.add(name, f, ["a"])
        models.add("other", f, ["c"], ["a"], ["c"])
    return models, rows


def test_metrics_are_those_of_every_row_and_model(fitted, monkeypatch):
    models, rows = fitted
    plain = evaluate.classification_metrics(models.score(rows, ["fold", "y"]).withColumn("p", F.round("p", 9)), ["model", "fold"])
    met, score = [], linear.FoldModels.score
    monkeypatch.setattr(linear.FoldModels, "score", lambda self, df, *a: met.append((df.count(), len(self.solved))) or score(self, df, *a))
    key = lambda d: sorted(map(tuple, d.select(plain.columns).collect()))
    assert [pytest.approx(r) for r in key(linear.metrics(models, rows))] == key(plain)
    assert met == [(54, 8)]  # of 400 rows and 12 models


def test_changes_of_repeated_keys_are_summed(fitted):
    models, rows = fitted
    got = {(r["model"], r["fold"], r["scenario"]): r for r in linear.perturbation(models, rows, ["k"], ["c"]).collect()}
    assert len(got) == 3 * 4 * 3
    moved = {s: models.score(rows, ["fold", "k"], {"c": F.lit(None).cast("double")} if s == "train_median" else evaluate.perturbed(["c"], s)).withColumn("p", F.round("p", 9)).groupBy("model", "fold", "k").agg(F.sum("p").alias("p")).toPandas().set_index(["model", "fold", "k"])["p"] for s in (*evaluate.SHIFTS, "train_median")}
    for (model, fold, scenario), r in got.items():
        d = (moved[scenario] - moved["original"]).loc[model, fold]
        want = (d.mean(), d.abs().mean(), d.abs().median(), d.abs().quantile(0.95), d.abs().max(), (d.abs() > 0.05).mean())
        assert tuple(r[c] for c in ("mean_delta", "mean_abs_delta", "median_abs_delta", "p95_abs_delta", "max_abs_delta", "share_over_005")) == pytest.approx(want, abs=1e-12)
