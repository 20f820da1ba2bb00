"""Boundaries of least padding over exact lengths."""

from __future__ import annotations

import itertools

from terrasieve.llm import packing


def test_lengths_near_each_other_are_not_merged(spark):
    counts = {513: 10, 516: 1, 520: 10, 1030: 5, 1039: 6}
    rows = [(i, x) for i, x in enumerate(x for x, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "row_id long, length long")
    for k in (2, 3, 4):
        padding = packing.pack(df, "length", ["row_id"], n_buckets=k).groupBy().sum("padding").first()[0]
        cost = lambda cut: sum(n * (min(b for b in cut if b >= x) - x) for x, n in counts.items())
        assert padding == min(cost((*c, 1039)) for c in itertools.combinations(list(counts)[:-1], k - 1))
