"""Exact draws within class, and single linkage at all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import guards, spatial, splits

from .test_nearest import km


def test_draws_are_exact_and_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(splits, "ROWS_PER_PART", 2)  # a tree of three levels
    monkeypatch.setattr(splits, "FIRST_PARTS", 16)
    df = spark.range(600).select("id", (F.col("id") % 3).alias("env"), F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 11 != 0, 0).alias("y"))
    of = lambda d: {r["id"]: r["times"] for r in splits.resampled(d, ["env", "y"], ["id"], 40, 9).collect()}
    got = of(df.repartition(5))
    assert got == of(df.repartition(2, "y").sortWithinPartitions(F.desc("id"))) and len(got) == 600
    rows = {r["id"]: (r["env"], r["y"]) for r in df.collect()}
    for group in set(rows.values()):
        times = np.array([got[i] for i, g in rows.items() if g == group])
        assert (times.sum(axis=0) == len(times)).all()
    times = np.array(list(got.values()))
    assert abs(times.var() - 1) < 0.05 and abs(np.corrcoef(times.T)[np.triu_indices(40, 1)].mean()) < 0.05
    assert of(df.limit(0)) == {}
    other = {r["id"]: r["times"] for r in splits.resampled(df, ["env", "y"], ["id"], 40, 8).collect()}
    assert other != got


def test_repeated_rows_are_drawn_each(spark):
    df = spark.createDataFrame([(1, None, 5)] * 30 + [(2, "a", 6)], "id long, env string, v int")
    got = splits.resampled(df, ["env"], ["id"], 10).collect()
    assert len(got) == 31 and all(sum(r["times"][i] for r in got if r["env"] is None) == 30 for i in range(10))
    assert [list(r["times"]) for r in got if r["env"] == "a"] == [[1] * 10]


def test_drawn_clusters_are_counted(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5,) for i in range(20)], "c int")
    sums = splits.draws(df, "c", 7, 3).groupBy("iteration").agg(F.sum("times").alias("n")).collect()
    assert len(sums) == 7 and {r["n"] for r in sums} == {5}
    monkeypatch.setattr(splits, "MOST_DRAWN", 4)
    with pytest.raises(guards.ContractError):
        splits.draws(df, "c", 7, 3)


def test_linkage_at_all_distances(spark):
    rng = np.random.default_rng(2)
    centres = rng.uniform(-1, 1, size=(12, 2)) + [45, 7]
    rows = [(i, *map(float, centres[i % 12] + rng.normal(size=2) * 0.03)) for i in range(150)] + [(150, None, 7.0), (151, 45.0, 7.0), (152, 45.0, 7.0), (153, -80.0, 179.99), (154, -80.0, -179.99)]
    radii = (1.5, 4, 9, 30)
    got = {r["id"]: r for r in spatial.linkage(spark.createDataFrame(rows, "id int, lat double, lon double"), "id", radii).collect()}
    placed = [r for r in rows if r[1] is not None]
    apart = {(a[0], b[0]): km(a, b) for a in placed for b in placed}
    assert len(got) == len(rows) and got[150]["cluster_30"] == 150
    for radius in radii:
        label = {a[0]: a[0] for a in placed}
        changed = True
        while changed:
            changed = False
            for (a, b), d in apart.items():
                if d <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
        assert {i: got[i][f"cluster_{radius:g}"] for i in label} == label
