"""Nearest rows by a tree of cells, and statistics outside buffers, against brute force."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import spatial
from terrasieve.plans import training


def km(a, b):
    la, lo, lb, lp = map(np.radians, (a[1], a[2], b[1], b[2]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def globe(spark):
    """Points all over, a crowd of one fold at the date line, poles, rows of
    one place, and rows without a place, fold or label."""
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), int(rng.integers(0, 4)), int(rng.integers(0, 2))) for i in range(200)]
    rows += [(200 + i, 45.0 + float(rng.normal()) * 1e-4, 179.9999 + float(rng.uniform(0, 1e-4)), 0, 1) for i in range(150)]
    rows += [(601, 45.0, -180.0, 1, 0), (602, 45.0, -180.0, 1, 0), (603, 45.0, -180.0, 2, None), (604, 90.0, 10.0, 1, 1), (605, 90.0, -170.0, 2, 0), (606, None, 3.0, 1, 1), (607, 4.0, 3.0, None, 1)]
    return rows, spark.createDataFrame(rows, "id int, lat double, lon double, fold int, y int")


@pytest.mark.parametrize("alike", [None, True, False])
def test_nearest_of_another_fold_and_label(globe, alike):
    rows, df = globe
    more = {} if alike is None else {"label": "y", "alike": alike}
    got = {r["id"]: r for r in spatial.nearest(df, df, "id", "id", fold="fold", **more).collect()}
    placed = [r for r in rows if r[1] is not None and r[3] is not None and (alike is None or r[4] is not None)]
    assert set(got) == {r[0] for r in placed}
    for a in placed:
        best = min((km(a, b), b[0]) for b in placed if b[3] != a[3] and (alike is None or (a[4] == b[4]) == alike))
        assert got[a[0]]["km_apart"] == pytest.approx(best[0], abs=1e-6) and got[a[0]]["fold"] == a[3]
    if alike is None:  # of two rows of one place the smaller id
        assert got[200]["r_id"] == 601


def test_nearest_of_each_other_fold_within_a_distance(globe):
    rows, df = globe
    got = {(r["id"], r["r_fold"]): r["km_apart"] for r in spatial.nearest(df, df, "id", "id", fold="fold", each_fold=True, within_km=3000).collect()}
    want = {}
    placed = [r for r in rows if r[1] is not None and r[3] is not None]
    for a in placed:
        for b in placed:
            if a[3] != b[3] and (d := km(a, b)) <= 3000:
                want[a[0], b[3]] = min(want.get((a[0], b[3]), 1e9), d)
    assert got == pytest.approx(want, abs=1e-6)


def test_a_crowd_of_one_fold_costs_its_cells(spark):
    def took(n):
        crowd = spark.range(n).select("id", (F.rand(1) * 0.001 + 40).alias("lat"), (F.rand(2) * 0.001 + 10).alias("lon"), F.lit(0).alias("fold"))
        far = spark.range(5).select(F.col("id") + 10**6, F.lit(45.0) + F.col("id") * 0.01, F.lit(10.0), F.lit(1))
        df, began = crowd.union(far), time.perf_counter()
        assert spatial.nearest(df, df, "id", "id", fold="fold").count() == n + 5
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 2 * took(4_000) + 5


def test_statistics_outside_buffers(spark):
    rng = np.random.default_rng(5)
    n, radii = 250, (2.0, 5.0)
    df = pd.DataFrame({"id": range(n), "lat": rng.uniform(40, 41, n), "lon": rng.uniform(0, 1, n), "fold": rng.integers(0, 3, n), "y": rng.integers(0, 2, n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    df.loc[rng.random(n) < 0.1, "a"] = np.nan
    sdf = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in df.astype(object).itertuples(index=False, name=None)], "id long, lat double, lon double, fold long, y long, a double, b double")
    parts = training.buffered(sdf, "fold", [0, 1, 2], "id", radii)
    sets = training.buffered_sets([0, 1, 2], radii)
    fills = training.medians_of_sets(parts, ["a", "b"], sets)
    grams = training.grams_of_sets(parts, ["a", "b"], "y", sets, fills)
    apart = np.array([[km((0, *x), (0, *z)) for z in df[["lat", "lon"]].to_numpy()] for x in df[["lat", "lon"]].to_numpy()])
    assert set(grams) == {(f, r) for f in range(3) for r in (0.0, *radii)}
    for (f, r), g in grams.items():
        near = (apart[:, df.fold == f].min(axis=1) <= r) if r else np.zeros(n, dtype=bool)
        x = df[(df.fold != f) & ~near][["a", "b", "y"]]
        assert fills[f, r] == pytest.approx(x[["a", "b"]].median().to_dict())
        x = x.fillna(x.median())
        assert g.n == len(x) and np.allclose(g.cov, np.cov(x.T, bias=True)) and np.allclose(g.mean, x.mean())


def test_a_place_is_searched_once_for_all_its_folds(spark, monkeypatch):
    """Rows of one place have the same nearest row of a fold, whatever theirs."""
    written, settled = [], spatial.settled
    monkeypatch.setattr(spatial, "settled", lambda df: written.append(settled(df)) or written[-1])
    df = spark.range(20 * 12).select("id", (F.col("id") % 20 * 0.01 + 40).alias("lat"), F.lit(10.0).alias("lon"), F.floor(F.col("id") / 20).cast("int").alias("fold"))
    got = spatial.nearest(df, df, "id", "id", fold="fold", each_fold=True, within_km=1.0).collect()
    assert len(got) == 240 * 11 and all(r["km_apart"] == 0 and r["r_id"] == r["id"] % 20 + 20 * r["r_fold"] for r in got)
    assert max(w.count() for w in written) <= 20 * 12 * 8  # 20 places, 12 folds, cells around


def test_points_meet_lists_of_cells(spark, monkeypatch):
    """No task sorts a point once for each cell around it; lists may be cut."""
    points = spark.createDataFrame([(1, 40.2, 10.3), (2, 40.5, 10.0), (3, 80.0, 10.0), (4, None, 10.0)], "id int, lat double, lon double")
    cells = spark.range(100).select(F.col("id").alias("cell"), (F.floor(F.col("id") / 10) * 0.5 + 38.25).alias("lat"), (F.col("id") % 10 * 0.5 + 8.25).alias("lon"))
    want = {1: (44, True), 2: (43, True), 3: (None, False), 4: (None, False)}
    for length in (1024, 3):
        monkeypatch.setattr(spatial, "LIST", length, raising=False)
        out = spatial.grid_cell(points, cells, "id")
        assert {r["id"]: (r["cell"], r["in_cell"]) for r in out.collect()} == want
    assert "_cells" in out._jdf.queryExecution().optimizedPlan().toString()
