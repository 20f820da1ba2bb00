"""Forests from cells against a tree of rows, and all trees of the queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrasieve import queries as q
from terrasieve.plans import forest, linear


def plain(x, y, w, depth, least):
    """Best splits of rows, node by node: ({node: (feature, cut, gain)}, {leaf: share})."""
    gini = lambda m: (lambda a, b: a * b / (a + b) if a + b else 0.0)(w[0] * (m & (y == 0)).sum(), w[1] * (m & (y == 1)).sum())
    splits, leaves = {}, {}

    def grow(node, m):
        best = (1e-12, None, None)
        if node < 2**depth:
            for j in range(x.shape[1]):
                for c in range(x[:, j].max()):
                    left, right = m & (x[:, j] <= c), m & (x[:, j] > c)
                    if min(left.sum(), right.sum()) >= least and gini(m) - gini(left) - gini(right) > best[0] + 1e-9:
                        best = (gini(m) - gini(left) - gini(right), j, c)
        if best[1] is None:
            leaves[node] = w[1] * (m & (y == 1)).sum() / (w[0] * (m & (y == 0)).sum() + w[1] * (m & (y == 1)).sum())
            return
        splits[node] = (best[1], best[2], best[0])
        grow(2 * node, m & (x[:, best[1]] <= best[2]))
        grow(2 * node + 1, m & (x[:, best[1]] > best[2]))

    grow(1, np.ones(len(y), dtype=bool))
    return splits, leaves


class Every(np.random.Generator):
    """Draws that leave no feature out."""

    def permutation(self, x, axis=0):
        return np.array([0])


def test_a_tree_of_cells_is_that_of_its_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 7, (400, 1))
    y = (rng.random(400) < 0.2 + 0.6 * np.isin(x[:, 0], (1, 2, 5))).astype(int)
    cells, at = np.unique(x[:, 0], return_inverse=True)
    counts = [np.bincount(at[y == k], minlength=len(cells)) for k in (0, 1)]
    w = (len(y) / (2 * (y == 0).sum()), len(y) / (2 * (y == 1).sum()))
    s = forest.Settings(depth=3, bins=8)
    feature, cut, value, gain = forest.grown(np.asfortranarray(cells[:, None].astype(np.uint8)), *counts, w, [0], s, Every(np.random.PCG64(0)))
    splits, leaves = plain(x, y, w, 3, s.least_rows)
    assert {n for n in range(len(feature)) if feature[n] >= 0} == set(splits)
    for n, (j, c, g) in splits.items():
        assert (feature[n], cut[n]) == (j, c) and gain[n] == pytest.approx(g)
    for n, p in leaves.items():
        assert value[n] == pytest.approx(p)


def test_importances_of_each_group(spark):
    rng = np.random.default_rng(8)
    n = 900
    df = pd.DataFrame({"env": rng.integers(0, 3, n), "good": rng.normal(size=n), "bad": rng.normal(size=n)})
    df["y"] = np.where(df.env == 2, 1, (df.good + 0.3 * rng.normal(size=n) > 0).astype(int))
    df.loc[rng.random(n) < 0.1, "bad"] = np.nan
    sdf = spark.createDataFrame(df).repartition(5).selectExpr("*", "cast(null as double) AS none")
    got = {(g, c): v for g, c, v in forest.importances(sdf, "env", ["good", "bad", "none"], "y", forest.Settings(trees=30))}
    assert {g for g, _ in got} == {0, 1}  # the third has one class
    for e in (0, 1):
        assert got[e, "good"] > 0.7 > got[e, "bad"] > 0 == got[e, "none"] and sum(got[e, c] for c in ("good", "bad", "none")) == pytest.approx(1)
    assert got == {(g, c): v for g, c, v in forest.importances(sdf.coalesce(1), "env", ["good", "bad", "none"], "y", forest.Settings(trees=30))}


def test_environment_votes_grow_all_trees(spark, monkeypatch):
    class Stop(Exception):
        pass

    def importances(df, group, features, label, settings=None):
        raise Stop((settings or forest.Settings()).trees)

    monkeypatch.setattr(q, "items", lambda *_: spark.range(3).selectExpr("id AS env"))
    monkeypatch.setattr(q.stats, "selection_rates", lambda *_, **__: None)
    monkeypatch.setattr(q.splits, "resampled", lambda *_, **__: None)
    monkeypatch.setattr(q.logistic, "fit_all", lambda *_, **__: None)
    monkeypatch.setattr(q.logistic, "coefficients", lambda *_: [])
    monkeypatch.setattr(forest, "importances", importances)
    with pytest.raises(Stop, match="^500$"):
        q.environment_votes(spark, "")


def test_every_row_by_forests_that_did_not_see_it(spark):
    rng = np.random.default_rng(9)
    n = 600
    df = pd.DataFrame({"id": np.arange(n), "fold": rng.integers(0, 3, n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    df["b"] += df["c"]
    df["y"] = (df.a + 0.5 * rng.normal(size=n) > 0).astype(int)

    def scores(data):
        sdf = spark.createDataFrame(data).repartition(3)
        models = linear.fit_folds(sdf, ["a", "b", "c"], "y")
        recipes = {"raw": dict.fromkeys(models.grams, (["a", "b"], [])), "same": dict.fromkeys(models.grams, (["b", "a"], [])), "mixed": dict.fromkeys(models.grams, (["a"], ["b"]))}
        return forest.out_of_fold(models, sdf, "id", recipes, ["c"], forest.Settings(trees=60)).toPandas().pivot(index="id", columns="model", values="p").sort_index()

    got = scores(df)
    assert got.shape == (n, 3) and got.notna().all(axis=None) and (got["raw"] == got["same"]).all() and (got["raw"] != got["mixed"]).any()
    pos, neg = got["raw"][df.y == 1].to_numpy(), got["raw"][df.y == 0].to_numpy()
    assert (pos[:, None] > neg).mean() > 0.85
    own = df.fold == 0
    other = scores(df.assign(y=np.where(own, 1 - df.y, df.y)))  # labels that the fold's forests must not read
    assert np.array_equal(got[own], other[own]) and not np.array_equal(got[~own], other[~own])


def test_forest_out_of_fold_takes_no_pass_for_a_model(spark, monkeypatch):
    monkeypatch.setattr(q.experiments, "out_of_fold", lambda *_, **__: pytest.fail("a pass over the rows for each fold and recipe"))
    rows = q.forest_out_of_fold(spark, "/root/testdata/sf0.001").collect()
    assert {r["model"] for r in rows} == {"Full", "NoClimate", "M3_Broad"} and all(r["n_missing"] == 0 and r["n_rows"] == r["n_pos"] + r["n_neg"] for r in rows)
