"""Statistics of training rows by subtraction against those of the rows themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrasieve.operators import guards
from terrasieve.plans import linear, training


@pytest.fixture(scope="module")
def fifty(spark):
    """600 rows in 50 folds, with gaps, ties, a large mean and rows of no fold."""
    rng = np.random.default_rng(0)
    n = 600
    df = pd.DataFrame({"fold": rng.integers(0, 50, n).astype(float), "y": rng.integers(0, 2, n).astype(float), "a": rng.integers(0, 20, n).astype(float), "b": rng.normal(size=n) + 1e6, "c": rng.normal(size=n).round(1), "d": rng.normal(size=n), "env": rng.integers(0, 2, n)})
    for c, share in (("a", 0.1), ("c", 0.3), ("fold", 0.02)):
        df.loc[rng.random(n) < share, c] = np.nan
    rows = [tuple(None if v != v else int(v) if c in ("fold", "y", "env") else float(v) for c, v in zip(df.columns, r)) for r in df.itertuples(index=False, name=None)]
    return df, spark.createDataFrame(rows, "fold int, y int, a double, b double, c double, d double, env int")


def test_medians_and_products_of_every_training_set(fifty):
    df, sdf = fifty
    folds = training.fold_names(sdf, "fold")
    fills = training.medians(sdf, list("abcd"), "fold", folds, ["env"])
    grams = training.grams(sdf, list("abcd"), "y", "fold", folds, fills, ["env"])
    assert len(folds) == 50 and len(grams) == 100
    for (f, env), g in grams.items():
        x = df[(df.fold != f) & (df.env == env)][[*"abcd", "y"]]
        assert fills[f, env] == pytest.approx(x[list("abcd")].median().to_dict())
        x = x.fillna(x.median())
        assert g.n == len(x) and np.allclose(g.mean, x.mean()) and np.allclose(g.cov, np.cov(x.T, bias=True), atol=1e-8)


def test_rank_correlations_of_every_training_set(fifty):
    df, sdf = fifty
    folds = training.fold_names(sdf, "fold")
    gaps = training.spearman_pairs(sdf, ["a", "b"], ["c", "d"], "fold", folds).collect()
    full = training.spearman_wide(sdf, [("b", "d"), ("y", "b")], "fold", folds).collect()
    assert len(gaps) == 200 and len(full) == 100
    for r in [*gaps, *full]:
        x = df[df.fold != r["test_fold"]][[r["target"], r["covariate"]]].dropna()
        assert r["n_pairs"] == len(x) and r["spearman"] == pytest.approx(x.rank().corr().iloc[0, 1], abs=1e-9)


def test_many_pairs_take_the_shorter_way(fifty, monkeypatch):
    _, sdf = fifty
    folds = training.fold_names(sdf, "fold")[:3]
    key = lambda d: {(r["test_fold"], r["target"], r["covariate"]): r["spearman"] for r in d.collect()}
    want = key(training.spearman_pairs(sdf, list("abd"), list("bcy"), "fold", folds))
    monkeypatch.setattr(training.stats, "MOST_PAIRS", 2)
    assert key(training.spearman(sdf, list("abd"), list("bcy"), "fold", folds)) == pytest.approx(want)


def test_few_pairs_and_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([(i % 2, float(i), 1.0, None if i < 38 else float(i)) for i in range(40)], "fold int, a double, one double, rare double")
    got = training.spearman_pairs(df, ["a"], ["one", "rare"], "fold", [0, 1], min_pairs=10).collect()
    assert all(r["spearman"] is None for r in got) and {r["n_pairs"] for r in got} == {20, 1}


def test_folds_are_counted_and_empty_tables_are_empty(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "fold int, a double")
    monkeypatch.setattr(training, "MOST_FOLDS", 4)
    with pytest.raises(guards.ContractError):
        training.fold_names(df, "fold")
    none = spark.createDataFrame([], "fold int, y int, a double")
    assert training.fold_names(none, "fold") == [] and linear.fit_folds(none, ["a"], "y").grams == {}


def test_rows_are_read_once_whatever_the_folds(spark, tmp_path):
    """Rows written by all shuffles together do not grow with the folds."""

    def shuffled(n_folds):
        df = spark.range(4000).selectExpr(f"cast(id % {n_folds} as int) as fold", "cast(id % 2 as int) as y", "cast(id % 37 as double) as a", "cast(id % 11 as double) as b")
        folds = training.fold_names(df, "fold")
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"folds-{n_folds}", "")
        linear.fit_folds(df, ["a", "b"], "y")
        training.spearman_pairs(df, ["a"], ["b"], "fold", folds).collect()
        jobs = tracker.getJobIdsForGroup(f"folds-{n_folds}")
        spark.sparkContext.setJobGroup("", "")
        return len(jobs)

    assert shuffled(40) <= shuffled(2) + 1  # no job, and no copy of a row, for a fold
