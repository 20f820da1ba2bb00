"""Graphs of training folds: effects as of the rows alone, planted edges found, test rows without influence."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import stats
from terrasieve.plans import fold_graph, training

GROUPS = {"ore": "geochemistry", "rock": "geochemistry", "rain": "climate", "heat": "climate"}


@pytest.fixture(scope="module")
def rows(spark):
    """Rain drives ore, everywhere but in fold 2, where heat drives rock; ore
    makes the label. Three environments, three folds."""
    rng = np.random.default_rng(8)
    out = []
    for i in range(900):
        fold, env = i % 3, i // 3 % 3
        rain, heat, noise = rng.normal(size=3)
        ore = (0.8 * rain if fold != 2 else 0) + 0.5 * noise
        rock = (0.9 * heat if fold == 2 else 0) + 0.5 * rng.normal()
        y = int(ore + 0.5 * rng.normal() > 0)
        out.append((fold, f"e{env}", y, float(ore), None if i % 17 == 0 else float(rock), float(rain), float(heat)))
    return spark.createDataFrame(out, "fold int, env string, y int, ore double, rock double, rain double, heat double")


def found(rows, **more):
    return fold_graph.discover(rows, list(GROUPS), "y", GROUPS, ["ore", "rock"], ["rain", "heat"], "env", **more)


def test_effects_are_those_of_the_training_rows(rows):
    got = {(r["test_fold"], r["env"], r["concept"]): r for r in training.effects(rows, "env", "y", list(GROUPS), "fold", [0, 1, 2]).collect()}
    assert len(got) == 36
    for f in range(3):
        for r in stats.feature_effects(rows.where(F.col("fold") != f), "env", "y", list(GROUPS)).collect():
            g = got[f, r["env"], r["concept"]]
            assert (g["n_positive"], g["n_negative"], g["direction"]) == (r["n_positive"], r["n_negative"], r["direction"])
            assert (g["auc"], g["mean_difference"]) == pytest.approx((r["auc"], r["mean_difference"]))


def test_planted_edges_are_found_in_their_folds(rows):
    g = found(rows, rules=fold_graph.Rules(auc=0.0))  # all columns are candidates
    edges = {(r["test_fold"], r["source"], r["target"]): r["env_count"] for r in g.consensus.collect()}
    assert edges[2, "rain", "ore"] == 3 and (2, "heat", "rock") not in edges  # fold 2 tests what only its rows show
    assert edges[0, "rain", "ore"] == 3 and edges[0, "heat", "rock"] == 3
    assert all(edges[f, "ore", "y"] == 3 for f in range(3))
    assert "ore" in g.targets()[2] and "rock" not in g.targets()[2]
    assert {r["test_fold"]: r["n_targets"] for r in g.summary().collect()}[2] == 1


def test_test_rows_have_no_influence(rows):
    moved = rows.withColumns({c: F.when(F.col("fold") == 1, -3 * F.col(c) + F.col("ore")).otherwise(F.col(c)) for c in GROUPS})
    of = lambda g: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in g.fused.where("test_fold = 1").collect())
    assert of(found(rows)) == of(found(moved))


def test_evidence_and_sparse_models_vote(rows, spark):
    strict = fold_graph.Rules(auc=2.0)
    assert found(rows, rules=strict, sparse=False).targets() == found(rows, rules=fold_graph.Rules(auc=2.0), sparse=False).targets()
    none = found(rows, rules=strict, sparse=False)
    assert none.signals.where("is_candidate").count() == 0 and none.consensus.count() == 0
    rate = spark.createDataFrame([(f, f"e{e}", "ore", 0.6) for f in range(3) for e in range(2)], "test_fold int, env string, concept string, rate double")
    assert {r["concept"] for r in found(rows, rules=strict, sparse=False, evidence=rate).signals.where("is_candidate").collect()} == {"ore"}
    assert found(rows, rules=strict).signals.where("is_candidate").count() > 0
