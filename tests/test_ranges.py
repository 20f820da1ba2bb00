"""Sums before a row by ranges, and rank correlations by their narrow side."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import ranges, stats
from terrasieve.plans import training


@pytest.mark.parametrize("by", [[], ["g"], ["g", "x"]])
def test_ranges_are_summed_where_they_were_dealt_to(spark, by):
    rng = np.random.default_rng(2)
    rows = [([None, "a", "b"][rng.integers(0, 3)], [None, float("nan"), 0.5][rng.integers(0, 3)], i, int(rng.integers(0, 9))) for i in rng.permutation(3000).tolist()]
    df = spark.createDataFrame(rows, "g string, x double, o int, v int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = ranges.running_sums(df, by, [F.desc("o")], {"n": F.lit(1).cast("long"), "s": "v", "d": F.col("v") * 0.5}, most=9000, rows_per_range=500)
        rows_got = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.columns == ["g", "x", "o", "v", "n", "s", "d"] and len(rows_got) == 3000
    sums: dict = {}
    for r in sorted(rows_got, key=lambda r: -r["o"]):
        n, s = sums.setdefault(tuple(repr(r[c]) for c in by), [0, 0])
        assert (r["n"], r["s"]) == (n, s) and r["d"] == pytest.approx(s / 2)
        sums[tuple(repr(r[c]) for c in by)] = [n + 1, s + r["v"]]


def test_narrow_and_wide_pairs_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"fold": rng.integers(0, 3, 600), "t": rng.random(600).round(2), "c": rng.integers(0, 5, 600) / 4})
    data.loc[rng.random(600) < 0.2, "t"] = np.nan
    df = spark.createDataFrame(data).replace(float("nan"), None)
    taken = []
    narrow = stats._ranked_narrow
    monkeypatch.setattr(stats, "_ranked_narrow", lambda *a: taken.append(1) or narrow(*a))
    key = lambda r: tuple(r[:-2])
    runs = []
    for most in (10_000, 0):
        monkeypatch.setattr(stats, "NARROW", most)
        runs.append((sorted(stats.spearman_pairs(df, ["t"], ["c"], by=["fold"]).collect(), key=key), sorted(training.spearman_pairs(df, ["t"], ["c"], "fold", [0, 1, 2]).collect(), key=key)))
    assert taken == [1]
    for a, b in zip(*runs):
        assert [key(r) for r in a] == [key(r) for r in b] and [r["spearman"] for r in a] == pytest.approx([r["spearman"] for r in b])
    for r in runs[0][1]:
        train = data[(data.fold != r["test_fold"]) & data.t.notna()]
        assert (r["n_pairs"], r["target"], r["covariate"]) == (len(train), "t", "c") and r["spearman"] == pytest.approx(train.t.rank().corr(train.c.rank()))
