"""Rows meet the result of a search by their place, and labels share one search."""

from __future__ import annotations

import numpy as np
import pytest

from terrasieve.operators import spatial
from terrasieve.plans import training


def rows_of(n=240):
    rng = np.random.default_rng(8)
    some = lambda x: None if rng.random() < 0.05 else x
    return [(i, some(int(rng.integers(0, 3))), some(int(rng.integers(0, 2))), some(float(rng.integers(0, 12)) / 4), float(rng.integers(0, 12)) / 4) for i in range(n)]


def km(a, b):
    la, oa, lb, ob = map(np.radians, (a[3], a[4], b[3], b[4]))
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - oa) / 2) ** 2))


def near(rows, a):
    return [b for b in rows if None not in (a[1], a[3], b[1], b[3]) and a[1] != b[1]]


def test_labels_share_one_search(spark, monkeypatch):
    rows, calls, nearest = [r for r in rows_of() if r[2] is not None], [], spatial.nearest
    monkeypatch.setattr(spatial, "nearest", lambda *a, **k: calls.append(1) or nearest(*a, **k))
    for part, most in ((rows, 1), (rows_of(), 2)):
        calls.clear()
        got = {r["k"]: r for r in spatial.label_neighbours(spark.createDataFrame(part, "k int, f int, y int, lat double, lon double"), "f", "k", "y").collect()}
        assert len(calls) == most and len(got) == len(part)
        for a in part:
            others = near(part, a)
            same, other = ([km(a, b) for b in others if None not in (a[2], b[2]) and (a[2] == b[2]) == alike] for alike in (True, False))
            for name, d in (("any_km", [km(a, b) for b in others]), ("same_label_km", same), ("opposite_label_km", other)):
                assert got[a[0]][name] == (pytest.approx(min(d), abs=1e-6) if d else None)


def test_rows_meet_their_place_once(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "k int, f int, y int, lat double, lon double")
    left = spatial.remove_buffers(df, "f", "k", 40.0)
    assert "LeftAnti" not in left._jdf.queryExecution().toString()  # no row is shuffled once for each fold
    want = sorted((f, a[0]) for a in rows for f in (0, 1, 2) if a[1] not in (None, f) and all(km(a, b) > 40 for b in near(rows, a) if b[1] == f))
    assert sorted(map(tuple, left.select("f", "k").collect())) == want
    out = {r["k"]: sorted(r["_out"]) for r in training.buffered(df, "f", [0, 1, 2], "k", [30.0, 60.0]).collect()}
    for a in rows:
        parts = [] if a[1] is None else [a[1] * 3]
        for f in (0, 1, 2):
            d = [km(a, b) for b in near(rows, a) if b[1] == f]
            if d and min(d) <= 60:
                parts.append(f * 3 + (1 if min(d) <= 30 else 2))
        assert out[a[0]] == sorted(parts)
