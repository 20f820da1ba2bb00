"""Texts of many near-duplicate candidates are not shuffled."""

from __future__ import annotations

import random

import pytest

from terrasieve.llm import common, neardup


def test_marked_rows_are_those_of_the_ids_and_few_others(spark, monkeypatch):
    df = spark.range(-2000, 6000).selectExpr("id", "id * 2 AS v").union(spark.sql("select cast(null as long), 1L"))
    ids = spark.range(0, 3000, 3)
    monkeypatch.setattr(neardup, "BITS", 2**18)
    got = {r["id"] for r in neardup._marked(df, ids, "id").collect()}
    assert None not in got and set(range(0, 3000, 3)) <= got and len(got) < 1000 + 100
    assert neardup._marked(df, ids.limit(0), "id").count() == 0


def test_many_ids_shuffle_no_text(spark, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(40)]
    rows = [(i, base[i % 40] + (" tail" if i % 3 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, neardup.near_duplicates(docs, width=2).collect()))
    plans, settled = [], common.settled
    monkeypatch.setattr(common, "settled", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or settled(df))
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # ids of many documents
    try:
        got = sorted(map(tuple, neardup.near_duplicates(docs, width=2).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and any(r[2] != r[0] for r in got)
    (plan,) = [p for columns, p in plans if columns == ["rep", "n", "h"]]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
