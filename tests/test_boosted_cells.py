"""Boosted trees grown from counts of cells against those grown level by level."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrasieve import model_queries
from terrasieve.plans import boosting, linear

SETTINGS = boosting.Settings(trees=5, rate=0.3, bins=8, columns=0.75, pending=3, block=40, depth=3)


def table(spark):
    rng = np.random.default_rng(4)
    n = 500
    df = pd.DataFrame(rng.normal(size=(n, 4)), columns=["a", "b", "c", "d"]).assign(id=np.arange(n) * 3, fold=rng.integers(0, 2, n))
    df["y"] = (df.a - df.b * df.c + rng.normal(size=n) > 0.4).astype(int)
    sdf = spark.createDataFrame(df).repartition(3)
    models = linear.fit_folds(sdf, ["a", "b", "c", "d"], "y")
    recipes = {"all": (["a", "b", "c", "d"], []), "two": (["a", "b"], []), "same": (["b", "a"], []), "mixed": (["a"], ["b"])}
    return models, sdf, {n: dict.fromkeys(models.grams, of) for n, of in recipes.items()}


def scores(models, sdf, recipes):
    return boosting.boost(models, sdf, "id", recipes, ["d"], SETTINGS).toPandas().sort_values(["model", "id"]).reset_index(drop=True)


def test_cells_grow_the_trees_of_levels(spark, monkeypatch):
    given = table(spark)
    monkeypatch.setattr(boosting, "MOST_CELLS", 0)
    want = scores(*given)
    monkeypatch.setattr(boosting, "MOST_CELLS", 100)  # all but one model; several passes, rows and tables of counts
    for name, x in (("ROUND", 2), ("COUNTED", 60), ("HELD", 500), ("CELLS_A_ROW", 9)):
        monkeypatch.setattr(boosting, name, x)
    got = scores(*given)
    assert len(got) == 4 * 500 and (got[["model", "fold", "id", "y"]] == want[["model", "fold", "id", "y"]]).all(axis=None)
    assert np.allclose(got["p"], want["p"], atol=1e-9) and got["p"].std() > 0.05
    of = got.pivot(index="id", columns="model", values="p")
    assert (of["two"] == of["same"]).all() and (of["two"] != of["all"]).any()


def test_models_of_few_cells_take_no_pass_for_a_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_level", lambda *a: pytest.fail("a pass for one level of one tree"))
    models, sdf, recipes = table(spark)
    assert len(scores(models, sdf, recipes)) == 4 * 500


def test_the_query_grows_all_trees(monkeypatch):
    class Stop(Exception):
        pass

    def boost(models, df, key, recipes, climate, settings=None):
        raise Stop((settings or boosting.Settings()).trees)

    class Models:
        grams: dict = {}

    class Rows:
        def withColumn(self, *_):
            return self

    class Graphs:
        def targets(self):
            return {}

    monkeypatch.setattr(model_queries, "fitted", lambda *_: (Rows(), Models(), {}, None))
    monkeypatch.setattr(model_queries, "graphs", lambda *_, **__: Graphs())
    monkeypatch.setattr(model_queries.F, "xxhash64", lambda *_: None)
    monkeypatch.setattr(model_queries.boosting, "boost", boost)
    with pytest.raises(Stop, match="^400$"):
        model_queries.boosted_recipes(None, "")
