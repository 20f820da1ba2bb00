"""Times of resamples in few bytes, and rows that take no shuffle for a catalogue."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import stats


@pytest.mark.parametrize("iterations", [1, 5, 8, 100])
def test_times_come_back(iterations):
    rng = np.random.default_rng(iterations)
    times = rng.poisson(1, (300, iterations)).astype(np.int32)
    times[::7] *= 40
    times[5, 0], times[6] = 70_000, 0
    small = times.max(axis=1) < 256
    assert not small.all()
    assert (stats.unpacked_times(stats.packed_times(times), small, iterations) == times).all()
    assert stats.packed_times(times[:0]) == []


def test_a_row_of_100_resamples_takes_a_third_of_its_bytes():
    times = np.random.default_rng(2).poisson(1, (2000, 100)).astype(np.int32)
    assert sum(map(len, stats.packed_times(times))) < 36 * len(times)


def test_times_are_not_shuffled_to_find_environments(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stats, "_drawn_aucs", lambda rows, *_: seen.append(rows) or spark.createDataFrame([], "env long, concept string, iteration int, auc double"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # guesses of large tables
    try:
        df = spark.range(500).selectExpr("id", "id % 2 AS env", "id % 3 % 2 AS y", "cast(id AS double) AS a")
        stats.selection_rates(df, "env", "y", ["a"], lambda i: F.lit(1))
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
