"""Queries that do the whole job where their older namesakes do a part."""

from __future__ import annotations

import numpy as np

from terrasieve import queries as q

SF = "/root/testdata/sf0.001"


def test_bootstrap_draws_every_state_and_varies(spark):
    rows = q.state_draws(spark).collect()
    assert {r["state"] for r in rows} == set(range(25))
    resamples = {}
    for r in rows:
        resamples.setdefault(r["iteration"], []).append((r["state"], r["times"]))
    assert all(sum(t for _, t in x) == 25 and max(t for _, t in x) > 1 for x in resamples.values())
    assert len({tuple(sorted(x)) for x in resamples.values()}) == 20
    got = q.cluster_bootstrap_all_states(spark, SF).first()
    assert got["low"] < got["high"] and got["iterations"] == 20


def test_neighbours_and_buffers_of_every_fold(spark):
    pt = q.folded_points(spark, SF).toPandas()
    lat, lon = np.radians(pt["lat"].to_numpy()), np.radians(pt["lon"].to_numpy())
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(h, 1)))
    fold, ids = pt["fold"].to_numpy(), pt["id"].to_numpy()
    assert set(fold) == set(range(5))
    apart = np.where(fold[:, None] != fold, km, np.inf)

    got = q.nearest_neighbours_by_fold(spark, SF).toPandas().set_index("id")
    assert sorted(got.index) == sorted(ids)
    assert (got.loc[ids, "fold"].to_numpy() == fold).all()
    assert np.allclose(got.loc[ids, "km_apart"], apart.min(axis=1), atol=1e-3)
    at = {x: i for i, x in enumerate(ids)}
    met = apart[np.arange(len(ids)), [at[x] for x in got.loc[ids, "r_id"]]]
    assert np.allclose(met, apart.min(axis=1), atol=1e-3)

    want = {(f, int(i)) for f in range(5) for i in ids[(fold != f) & (km[:, fold == f].min(axis=1) > 20)]}
    rows = [tuple(r) for r in q.buffer_removal_by_fold(spark, SF).select("fold", "id").collect()]
    assert len(rows) == len(want) and set(rows) == want

    state = q.points(spark, SF).select("id", "state").toPandas().set_index("id").loc[ids, "state"].to_numpy()
    left = {r["state"]: (r["own"], r["n_train"]) for r in q.buffer_removal(spark, SF).collect()}
    assert left == {x: (int((state == x).sum()), int(((state != x) & (km[:, state == x].min(axis=1) > 20)).sum())) for x in set(state)}
