"""AUCs of all resamples by ranges of values, against pairs of rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import splits, stats


def won(rows, i):
    """Share of pairs that the positive row wins, ties half; NaN is largest."""
    at = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    p, n = ([(at(v), t[i]) for v, y, t in rows if y == side and v is not None] for side in (True, False))
    pairs = sum(a * b * (1.0 if v > w else 0.5 if v == w else 0.0) for v, a in p for w, b in n)
    return pairs / (sum(a for _, a in p) * sum(b for _, b in n))


def test_all_resamples_of_all_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(e), bool(y), [int(t) for t in rng.poisson(1, 5)], None if v % 11 == 0 else float("nan") if v == 7 else float(v), None if v is None else True) for e, y, v in zip(rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 40, 300))]
    rows = [(e, y, [t[0] + 300, *t[1:]], v, v is not None) for e, y, t, v, _ in rows]  # sums beyond a byte
    df = spark.createDataFrame(rows, "env int, y boolean, times array<int>, v0 double, has0 boolean").repartition(7)
    got = stats._drawn_aucs(df, ["a"], 5).collect()
    assert len(got) == 10
    for r in got:
        assert r["auc"] == pytest.approx(won([(v, y, t) for e, y, t, v, _ in rows if e == r["env"]], r["iteration"]), abs=1e-12)


def test_drawn_rows_carry_no_other_row_to_a_join(spark):
    """A row of a resample is shuffled once, before its draws are made."""
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("env"))
    drawn = splits.resampled(df, ["env"], ["id"], 100)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 0 and "ArrowEvalPython" in plan
    assert sum(sum(r["times"]) for r in drawn.collect()) == 5000 * 100
