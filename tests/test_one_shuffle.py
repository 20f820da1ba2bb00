"""Scores meet in the ranges that rank them, and sums of ranges are sent to the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrasieve.operators import evaluate, ranges
from terrasieve.plans import linear, training


def plans(monkeypatch):
    """The plans of all tables that ``ranges`` writes out."""
    seen, settled = [], ranges.settled
    monkeypatch.setattr(ranges, "settled", lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or settled(d))
    return seen


def test_scores_are_shuffled_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"model": rng.choice(["a", "b"], 900), "fold": rng.integers(0, 2, 900), "y": rng.integers(0, 2, 900), "p": rng.random(900).round(2), "w": rng.integers(1, 4, 900)})
    df = spark.createDataFrame(data)
    want = sorted(evaluate.classification_metrics(df, ["model", "fold"], weight="w").collect())
    seen = plans(monkeypatch)
    joined = evaluate.classification_metrics(df, ["model", "fold"], weight="w", most=6 * ranges.ROWS_PER_RANGE)
    assert seen[0].count("Exchange") == 1 and "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    got = sorted(joined.collect())
    for a, b in zip(got, want, strict=True):
        assert list(a) == pytest.approx(list(b))


@pytest.mark.parametrize("repeated", [0.0, 2.0])
def test_models_without_weights_and_rows_as_they_are(spark, monkeypatch, repeated):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"fold": rng.integers(0, 2, 400), "y": rng.integers(0, 2, 400), "x": rng.integers(0, 30, 400) / 8})
    df = spark.createDataFrame(data)
    models = linear.FoldModels(["x"], "y", "fold", {0: {"x": 0.0}, 1: {"x": 0.0}}, {}, [("flat", 0, 0.7, [0.0]), ("flat", 1, 0.2, [0.0]), ("same", 1, 0.2, [0.0]), ("up", 0, 0.1, [0.3]), ("up", 1, 0.0, [0.2])])
    monkeypatch.setattr(linear, "REPEATED", repeated)
    got = {(r["model"], r["fold"]): r for r in linear.metrics(models, df).collect()}
    assert sorted(got) == [("flat", 0), ("flat", 1), ("same", 1), ("up", 0), ("up", 1)]
    for name, f, b0, (b,) in models.solved:
        part = data[data.fold == f]
        p, pos = b0 + b * part.x.to_numpy(), part.y.to_numpy() == 1
        won = (p[pos][:, None] > p[~pos]).mean() + (p[pos][:, None] == p[~pos]).mean() / 2
        r = got[name, f]
        assert (r["n_pos"], r["n_neg"]) == (pos.sum(), (~pos).sum()) and r["roc_auc"] == pytest.approx(won)
        assert r["tp"] == (p[pos] >= 0.5).sum() and r["fp"] == (p[~pos] >= 0.5).sum()


def test_medians_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = pd.DataFrame({"fold": rng.integers(0, 3, 500), "x": rng.random(500)})
    monkeypatch.setattr(ranges.running_sums, "__defaults__", (60, None, None))
    got = training.medians(spark.createDataFrame(data), ["x"], "fold", [0, 1, 2])
    for f in range(3):
        assert got[f,]["x"] == pytest.approx(data[data.fold != f].x.median())
