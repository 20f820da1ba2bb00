"""Contamination by a transform of products against columns that are really contaminated."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrasieve.plans import linear


def ridge(x, y, alpha=10.0):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(axis=0)))
    return lambda v: y.mean(axis=0) + ((v - mean) / sd) @ w


def test_all_strengths_are_those_of_contaminated_columns(spark):
    rng = np.random.default_rng(6)
    n = 300
    x = rng.normal(size=(n, 4)) * [1, 3, 1, 2] + [5, 0, 1, 9]
    x[:, 3] += x[:, 2]
    df = pd.DataFrame(x, columns=["ore", "rock", "rain", "heat"]).assign(y=(rng.random(n) < 0.4).astype(int), fold=rng.integers(0, 3, n), id=range(n))
    df.loc[rng.random(n) < 0.1, ["rock"]] = np.nan
    df.loc[rng.random(n) < 0.1, ["heat"]] = np.nan
    sdf = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in df.astype(object).itertuples(index=False, name=None)], "ore double, rock double, rain double, heat double, y long, fold long, id long")
    climate, gammas = ["rain", "heat"], (0.0, 1.5)
    models = linear.fit_folds(sdf, ["ore", "rock", *climate], "y")
    told = linear.contamination(models, linear.own_grams(sdf, models), ["ore"], climate, gammas, {"raw": (["ore", "rock"], []), "broad": ([], ["ore", "rock"])})
    scores = {(r["model"], r["id"]): r["p"] for r in models.score(sdf, ["id"]).collect()}
    assert len(told) == 12 and len(scores) == 4 * n
    for gamma, name, f, recovery, damage, r2 in told:
        train, test = df[df.fold != f], df[df.fold == f]
        cols = ["ore", "rock", *climate]
        fill = train[cols].median()
        a, b = train[cols].fillna(fill), test[cols].fillna(fill)
        z = (a[climate] - a[climate].mean()) / a[climate].std(ddof=0)
        v = np.linalg.eigh(np.corrcoef(z.T))[1][:, -1]
        v = v * np.sign(v[0])
        spread = (z @ v).std(ddof=0)
        sd = a.ore.std(ddof=0)
        score = lambda t: (((t[climate] - a[climate].mean()) / a[climate].std(ddof=0)) @ v / spread).to_numpy()  # noqa: B023, E731
        dirty = [t.assign(ore=t.ore + gamma * sd * score(t)) for t in (a, b)]
        fields = [t[["ore", "rock"]].to_numpy() for t in dirty]
        if name == "broad":
            of = ridge(dirty[0][climate].to_numpy(), fields[0])
            fields = [t - of(d[climate].to_numpy()) for t, d in zip(fields, dirty)]
        assert recovery == pytest.approx(np.sqrt(np.mean(((fields[1][:, 0] - b.ore) / sd) ** 2)))
        assert damage == (None if name == "raw" else pytest.approx(np.sqrt(np.mean(((fields[1][:, 1] - b.rock) / a.rock.std(ddof=0)) ** 2))))
        guess = ridge(a[climate].to_numpy(), fields[0][:, :1])(b[climate].to_numpy())[:, 0]
        assert r2 == pytest.approx(1 - ((fields[1][:, 0] - guess) ** 2).sum() / ((fields[1][:, 0] - fields[1][:, 0].mean()) ** 2).sum())
        want = ridge(fields[0], train.y.to_numpy().astype(float))(fields[1])
        assert [scores[f"{name}/{gamma:g}", i] for i in test.id] == pytest.approx(list(want))
