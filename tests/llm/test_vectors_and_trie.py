"""Exact clusters, vector links and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.llm import subspace, trie, vector_queries, yinyang
from terrasieve.operators.components import least_reached

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, n_links string, x string, unit string, c string"
TURNS = "conv_id long, turn long, role string, text string, c string, depth string, key string, n string"


def table(spark, rows, schema):
    extra = len(schema.split(",")) - len(rows[0]) if rows else 0
    return spark.createDataFrame([(*r, *(None,) * extra) for r in rows], schema)


def digest(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(vector_queries.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(vector_queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    want = sorted((tuple(dict(zip((c[0] for c in want.description), r))[n] for n in names) for r in want.fetchall()), key=repr)
    got = vector_queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == want


# clusters


def lloyd(ids, x, k, rounds, seed=1):
    order = sorted((i for i in range(len(x)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), list(x[i])))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        near = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = x[near == j].sum(0) // (near == j).sum()
    return near, d[np.arange(len(x)), near], c


@pytest.mark.parametrize("k,rounds,n_groups,levels", [(16, 3, None, 400), (9, 6, 3, 3), (30, 5, 1, 40)])
def test_clusters_as_lloyd_finds_them(spark, k, rounds, n_groups, levels):
    rng = np.random.default_rng(k)
    x = rng.integers(-levels, levels, size=(500, 4)) / 2.0  # few levels: many ties
    ids = [int(i) for i in rng.integers(-50, 400, size=500)]
    df = table(spark, [(i, list(map(float, v))) for i, v in zip(ids, x)], VECTORS).repartition(3)
    got, c = yinyang.cluster_vectors(df, k, rounds, dims=4, scale=2, n_groups=n_groups)
    near, dist, at = lloyd(ids, (x * 2).astype(np.int64), k, rounds)
    want = sorted((i, tuple(map(int, 2 * v)), int(a), int(d)) for i, v, a, d in zip(ids, x, near, dist))
    assert sorted((r["vec_id"], tuple(r["x"]), r["cluster"], r["distance"]) for r in got.collect()) == want
    assert (c.at == at).all()


def test_bounds_spare_distances():
    rng = np.random.default_rng(0)
    at = rng.integers(-1000, 1000, size=(40, 8))
    x = (at[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, size=(3000, 8))).astype(np.int64)
    c = yinyang.Centroids(at, yinyang.grouped(at, 8), np.zeros(40))
    cluster, upper, lower, first = yinyang.assign(x, c, np.full(3000, -1), np.zeros(3000), np.zeros((3000, c.group.max() + 1)))
    moved = c.to(at + rng.integers(-2, 3, size=at.shape))
    again, _, _, second = yinyang.assign(x, moved, cluster, upper, lower)
    assert first == 40 * 3000 and second < first / 20
    assert (again == yinyang.squares(x, moved.at).argmin(1)).all()


def test_large_components_are_exact():
    x = np.array([[2**27] * 64, [-(2**27)] * 64, [1] * 64], dtype=np.int64)
    assert yinyang.squares(x, x)[0, 1] == 64 * 2**56 and yinyang.squares(x, x)[0, 2] == 64 * (2**27 - 1) ** 2


def test_clusters_of_odd_rows(spark):
    ok = [float(i % 3) for i in range(64)]
    bad = [None, [], ok[:63], [*ok, 1.0], [None, *ok[1:]], [float("nan"), *ok[1:]], [float("-inf"), *ok[1:]]]
    rows = [(1, ok), (1, ok), (None, ok), (2, [0.0] * 64), (3, [1e300] * 64)]
    got, c = yinyang.cluster_vectors(table(spark, [*rows, *((i, v) for i, v in enumerate(bad))], VECTORS))
    got = got.collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "3", "None"] and len(c.at) == 4
    assert max(max(r["x"]) for r in got) == yinyang.BOUND and all(r["distance"] == 0 for r in got)
    none, c = yinyang.cluster_vectors(table(spark, [], VECTORS))
    assert none.collect() == [] and c is None


# links


def all_links(ids, x, least):
    u = subspace._unit(np.array(x))
    a, b = np.nonzero(u @ u.T >= least)
    node, component = least_reached(a, b)
    low = defaultdict(lambda: 10**9)
    for n, c in zip(node, component):
        low[c] = min(low[c], ids[n])
    return sorted((ids[n], int((a == n).sum()) - 1, low[c]) for n, c in zip(node, component))


@pytest.mark.parametrize("dims,crowds", [(64, [(300, 0.2), (120, 0.24), (40, 0.05)]), (6, [(200, 0.25)]), (2, [])])
def test_links_of_all_pairs(spark, monkeypatch, dims, crowds):
    """Loose and tight crowds, exact copies, and leaves cut small."""
    monkeypatch.setattr(subspace, "_HOME", 64)
    monkeypatch.setattr(subspace, "_GUESTS", 128)
    rng = np.random.default_rng(dims)
    x = [rng.normal(size=(250, dims))]
    for n, spread in crowds:
        centre = rng.normal(size=dims)
        x.append((centre / np.linalg.norm(centre) + rng.normal(size=(n, dims)) * spread / np.sqrt(dims)) * rng.uniform(0.1, 5, size=(n, 1)))
    x = np.concatenate(x)
    x = np.concatenate([x, x[:10], x[-30:]])
    ids = [int(i) for i in rng.permutation(len(x)) * 3]
    df = table(spark, [(i, list(map(float, v))) for i, v in zip(ids, x)], VECTORS)
    got = subspace.near_vectors(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == all_links(ids, x, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_boxes_find_every_leaf_in_reach():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(400, 3))
    boxes = subspace.Boxes.fit(p, 5)
    home = boxes.leaf(p)
    row, leaf = boxes.within(p, np.full(len(p), 0.3))
    met = set(zip(row.tolist(), leaf.tolist()))
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.09
    assert all((i, home[j]) in met for i, j in zip(*np.nonzero(near))) and len(met) < 400 * 32


def test_links_of_odd_rows(spark):
    rows = [
        (5, [1.0, 0.0]), (5, [1.0, 0.0]), (9, [2.0, 0.1]), (5, [0.0, 1.0]), (None, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]),
        (4, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.1]), (11, [1e-200, 0.0]), (12, [1e300, 1e298]), (13, [4.0]),
    ]
    got = subspace.near_vectors(table(spark, rows, VECTORS)).collect()
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr)
    one = lambda i: (False, i, 0, i, True)
    want = [*map(one, (1, 2, 3, 4, 6, 7, 13)), one(5), (True, 0, 0, None, True), *[(False, 5, 4, 5, True)] * 2, *[(False, i, 4, 5, False) for i in (9, 11, 12)], (False, 8, 1, 8, True), (False, 10, 1, 8, False)]
    assert got == sorted(want, key=repr)
    assert subspace.near_vectors(table(spark, [], VECTORS)).collect() == []


# conversations


def brute_trie(rows, heads=6, group=100):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members, path = defaultdict(list), {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % group) * (1 if c >= 0 else -1)
        path[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += children[p] == 0
    ends = {p: digest(sorted(c for c in m if len(path[c]) == len(p))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items()), key=repr)


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_as_brute_force(spark, monkeypatch, seed):
    """Few different turns, so that paths meet; pieces cut small."""
    monkeypatch.setattr(trie, "TURNS_PER_PIECE", 3)
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-150, 450), size=250, replace=False):
        turns = [(int(c), int(i), ["user", "bot"][i % 2], "ab😀"[: rng.integers(1, 4)]) for i in range(rng.choice([1, 3, 4, 9]))]
        rows += turns
    got = nodes(trie.prefix_trie(table(spark, rows, TURNS).repartition(3)))
    assert got == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 2, None, "x"), (0, 2, None, "x"), (0, 1, "bot", None), (0, 3, "", ""), (0, 3, "a", "y" * 200_000), (0, 4, "a", "z"),
        *[(c, 1, "u", "only") for c in range(1, 40)], (250, 1, "u", "no base"), (None, 1, "u", "nobody"), (-7, 1, "u", "below"), (-100, 1, "u", "t"),
    ]
    assert nodes(trie.prefix_trie(table(spark, rows, TURNS))) == brute_trie(rows)
    turnless = [(c, 1, "u", "t") for c in range(101, 130)]  # no base, most lose their only turn
    assert nodes(trie.prefix_trie(table(spark, turnless, TURNS))) == brute_trie(turnless)
    assert nodes(trie.prefix_trie(table(spark, [], TURNS))) == []


def test_ends_of_a_hot_node_are_streamed(spark):
    ids = [int(i) for i in np.random.default_rng(4).choice(10**7, 5000, replace=False)]
    ends = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 8)], "depth long, f1 long, f2 long, c long").repartition(5)
    got = {r["f2"]: r["ends_sha256"] for r in trie._hashed_ends(ends, 1000, 4).collect()}
    assert got == {3: digest(sorted(ids)), 4: digest([8])}
    got = trie._hashed_ends(ends.where(F.col("c") > 8), 10**6, 64).collect()
    assert [r["ends_sha256"] for r in got] == [digest(sorted(ids))] if min(ids) > 8 else True
