"""Negatives beyond what a ratio can take are not numbered."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import guards, splits


@pytest.mark.parametrize("ratio", [2, 200])
def test_first_negatives_in_order(spark, monkeypatch, ratio):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.random() < 0.02), None if rng.random() < 0.1 else int(rng.integers(0, 3)), None if rng.random() < 0.03 else int(rng.integers(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, y int, f int, o int")
    numbered, number = [], guards.number_within
    monkeypatch.setattr(guards, "number_within", lambda d, *a, **k: numbered.append(d.count()) or number(d, *a, **k))
    got = sorted(r["k"] for r in splits.with_ratio(df, "y", ratio, ["f"], [F.col("o") + 1, "k"]).collect())
    want = []
    for f in (None, 0, 1, 2):
        part = [r for r in rows if r[2] == f]
        pos = [r[0] for r in part if r[1]]
        neg = sorted((r for r in part if not r[1]), key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
        want += pos + [r[0] for r in neg[: ratio * len(pos)]]
    assert got == sorted(want)
    assert numbered[0] < 600 if ratio == 2 else numbered[0] > 2900
