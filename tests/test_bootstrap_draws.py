"""Metrics of resampled clusters against rows that are really repeated."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrasieve.operators import evaluate, splits


def plain(rows):
    """The seven metrics of repeated rows, by score, then order, y and cluster."""
    rows = rows.sort_values(["p", "o", "y", "c"], ascending=[False, True, True, True], kind="stable")
    y, p, n = rows.y.to_numpy(), rows.p.to_numpy(), len(rows)
    pos = y.sum()
    out = {}
    if 0 < pos < n:
        rank = rows.p.rank().to_numpy()
        out["roc_auc"] = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
        by = rows.groupby("p").y.agg(["sum", "count"]).sort_index(ascending=False)
        out["average_precision"] = (by["sum"] * by["sum"].cumsum() / by["count"].cumsum()).sum() / pos
    hit = p >= 0.5
    out["f1"] = 2 * y[hit].sum() / max(hit.sum() + pos, 1)
    for name, share in (("05", 0.05), ("10", 0.10)):
        k = max(1, int(np.ceil(n * share)))
        gain = 1 / np.log2(np.arange(k) + 2)
        hits = y[:k].sum()
        out[f"top{name}_f1"] = 2 * hits / (k + pos) if hits else 0.0
        ideal = gain[: min(k, pos)].sum()
        if ideal:
            out[f"top{name}_ndcg"] = (gain[: len(y[:k])] * y[:k]).sum() / ideal
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_every_draw_is_that_of_repeated_rows(spark, ties):
    rng = np.random.default_rng(4)
    n = 500
    rows = pd.DataFrame({"c": rng.integers(0, 9, n), "y": rng.integers(0, 2, n), "o": np.arange(n)})
    scores = [rows.assign(model=m, p=rng.integers(0, 8, n) / 7 if ties else rng.random(n)) for m in ("a", "b")]
    both = pd.concat(scores)
    df = spark.createDataFrame(both[["model", "c", "y", "p", "o"]]).repartition(3)
    times = splits.drawn_times(9, 25, 1)
    times[3] = 0
    times[3, 4] = 9  # one cluster alone
    got = evaluate.bootstrap_draws(df, "c", times, range(9), order="o", rows_per_range=90, block=16).collect()
    assert len(got) == 50
    for r in got:
        own = both[both.model == r["model"]]
        want = plain(own.loc[own.index.repeat(times[r["iteration"]][own.c])])
        for m in evaluate.DRAW_METRICS:
            assert r[m] == (pytest.approx(want[m], abs=1e-9) if m in want else None), (r["iteration"], m)


def test_discounts_beyond_the_table(monkeypatch):
    whole = evaluate._discounts(50_000)
    monkeypatch.setattr(evaluate, "_HELD", 1000)
    ranks = np.array([0, 999, 1000, 1001, 4321, 50_000])
    assert evaluate._discount(evaluate._discounts(50_000), ranks) == pytest.approx(whole[ranks], rel=1e-6)


def test_no_rows_and_one_class(spark):
    none = spark.createDataFrame([], "model string, c int, y int, p double, o int")
    assert evaluate.bootstrap_draws(none, "c", splits.drawn_times(3, 4, 1), range(3), order="o").collect() == []
    one = spark.createDataFrame([("a", i % 3, 1, i / 10, i) for i in range(10)], "model string, c int, y int, p double, o int")
    got = evaluate.bootstrap_draws(one, "c", splits.drawn_times(3, 4, 1), range(3), order="o").collect()
    assert len(got) == 4 and all(r["roc_auc"] is None and r["top05_ndcg"] == pytest.approx(1) for r in got)


def test_tops_of_many_rows_go_by_blocks():
    rng = np.random.default_rng(8)
    n, tops = 60_000, np.array([[30_000.0, 41_000.0, 70_000.0], [45_000.0, 80_000.0, 5.0]])
    y, at, times = rng.random(n) < 0.3, rng.integers(0, 6, n), rng.integers(0, 4, (3, 6)).astype(float)
    table = evaluate._discounts(200_000)
    got = evaluate._top_sums(y, at, times, np.array([9000.0, 9100.0, 0.0]), tops, table, 512)
    for d, above in enumerate((9000, 9100, 0)):
        repeated = np.repeat(y, times[d][at].astype(int))
        ranks = above + np.arange(len(repeated))
        for x in range(2):
            inside = repeated & (ranks < tops[x, d])
            assert got[2 * x, d] == inside.sum()
            assert got[2 * x + 1, d] == pytest.approx((1 / np.log2(ranks[inside] + 2)).sum(), rel=1e-7)


def test_only_metrics_that_are_asked_for(spark):
    df = spark.createDataFrame([("a", i % 3, i % 2, i / 10, i) for i in range(20)], "model string, c int, y int, p double, o int")
    times = splits.drawn_times(3, 4, 1)
    some, whole = (evaluate.bootstrap_draws(df, "c", times, range(3), order="o", **more) for more in ({"names": ("roc_auc", "f1")}, {}))
    assert some.columns == ["iteration", "model", "roc_auc", "f1"]
    assert sorted(some.collect()) == sorted(whole.select(some.columns).collect())
