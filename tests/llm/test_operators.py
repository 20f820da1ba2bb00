"""The corpus operators against brute force, enumeration and planted cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from terrasieve.llm import ann, common, crf, langid, lattice, licenses, mixing, neardup, packing, queries, rules, shards

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans(common.UPPER, common.UPPER.lower())


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def documents(spark, sf=SF):
    return common.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    long_text = "one two three " * 20_000
    rows = [
        (1, "The cat sat on the mat. " * 9, "en", "a", 5),
        (2, "The cat sat on the mat. " * 9, "en", "a", 5),
        (2, "The cat sat on the mat. " * 9, "en", "a", 5),
        (3, None, None, None, None),
        (None, "Le chat est sur la table", "fr", "b", None),
        (4, "", "en", None, 0),
        (5, " \t\n\x0b\x0c\r ", None, "b", 7),
        (6, long_text, "en", "b", 1),
        (7, "x" * 300_000, "de", "a", 1),
        (8, "naïve ÉCLAIR 日本語 \U0001f600 mit license\x00tail", "fr", "c", 1),
        (9, "solo", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["score", "kept", "n_words", "matches", "lang_pred", "shard", "slot", "size", "h", "n", "word", "value", "rep", "component", "label", "bucket"]
    return df.withColumns({c: F.lit("mine") for c in clash})


def empty(df):
    return df.where("false")


# --- sharding ---------------------------------------------------------------


def hash64(*parts):
    h = 42
    for p, width in parts:
        h = xxhash.xxh64_intdigest(p.to_bytes(width, "little", signed=True), seed=h)
    return h


def winner(key, weights):
    return min((-math.log(((hash64((key, 8), (s, 4)) >> 11) + 0.5) * 2.0**-53) / w, s) for s, w in enumerate(weights))[1]


def test_shards_are_rendezvous_hashing(spark):
    out = shards.op1_rendezvous_sharding(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    for r in out.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == winner(r.doc_id, [1.0] * 40) and r.grown_shard == winner(r.doc_id, [1.0] * 41)
        assert r.grown_shard in (r.shard, 40)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_shards_follow_weights_and_split_hot_groups(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    share = shards.assign_shards(df, ["doc_id"], [1.0, 3.0]).groupBy("shard").count().toPandas().set_index("shard")["count"] / 20_000
    assert share[1] == pytest.approx(0.75, abs=0.02)
    hot = common.settled(spark.range(3000).select((F.col("id") % 2 * 0).cast("long").alias("doc_id"), F.col("id").alias("row_id"), F.lit(3).alias("shard")))
    slots = common.number_slots(hot, "shard", ["doc_id", "row_id"], rows_per_bucket=100)
    assert sorted(r["slot"] for r in slots.collect()) == list(range(3000))


def test_shards_of_odd_rows(spark, odd):
    out = shards.assign_shards(odd, ["doc_id"], [1.0] * 5, grown_weight=1.0)
    assert out.count() == 11 and out.where("shard is null or grown_shard is null").isEmpty() and set(odd.columns) <= set(out.columns)
    assert shards.assign_shards(empty(odd), ["doc_id"], [1.0]).count() == 0
    with pytest.raises(ValueError):
        shards.assign_shards(odd, ["doc_id"], [])


# --- licences ---------------------------------------------------------------


def test_license_base_is_exact(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {r["doc_id"]: r["text"] for r in documents(spark, "/root/testdata/sf0.01").collect()}
    n = 0
    for r in licenses.op2_fuzzy_license_scan(spark, "/root/testdata/sf0.01").collect():
        w = word.findall(texts[r["doc_id"]].translate(LOWER))
        found = [(i, b.label) for b in licenses.BASE for i in range(len(w)) if w[i : i + len(b.phrase.split())] == b.phrase.split()]
        starts = [i for i, _ in found]
        want = (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and (r["score"] == 1.0) >= (len(found) > 0)
        n += len(found)
    assert n > 10


def test_license_edits_are_found_and_bounded():
    scanner = licenses.Scanner(licenses.NOTICES)
    rng = random.Random(5)
    for notice in licenses.NOTICES:
        for _ in range(30):
            s = list(notice.phrase)
            for _ in range(rng.randint(0, notice.edits)):
                i = rng.randrange(len(s))
                op = rng.randrange(3)
                s[i : i + 1] = [[], [rng.choice("qxz")], [s[i], "q"]][op]
            text = " ".join("".join(s).split())
            _, found = scanner.scan(f"some words then {text} and more")
            assert any(m[0] == notice.phrase for m in found), (notice, text)
            for phrase, _, _, _, edits, *_, span in found:
                own = next(n for n in licenses.NOTICES if n.phrase == phrase)
                assert edits <= own.edits and regex.fullmatch(rf"(?:{regex.escape(phrase)}){{e<={edits}}}", span)
    assert scanner.scan("permit license emit licenses the city apaches licensed nothing")[1] == []
    assert [m[2] for m in scanner.scan("mit license mit license")[1]] == [0, 2]


def test_license_scan_of_odd_rows(spark, odd):
    out = {r["doc_id"]: r for r in licenses.scan_notices(odd).where("doc_id <> 2").collect()}
    assert out[3]["n_words"] == 0 and out[4]["matches"] == [] and out[8]["matches"][0]["label"] == "mit" and out[8]["source"] == "c"
    assert licenses.scan_notices(empty(odd)).count() == 0


# --- quality rules ----------------------------------------------------------


def plain_measures(text):
    t = text or ""
    w = words_of(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    covered = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(ch in rules.SYMBOLS for ch in t), len(lines) - len(set(lines)), len(covered)


def test_rules_count_as_plain_code(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab |#\n\t\x0b") for _ in range(rng.randrange(0, 80))) for _ in range(300)] + ["a a a a", "a b c a b c", "a b c d a b c", None, "", " ", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.apply_rules(df).collect():
        want = plain_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["text"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_agree_with_labels_and_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = rules.op3_quality_rules(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("not base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.05


def test_rules_of_odd_rows(spark, odd):
    out = {r["doc_id"]: r for r in rules.apply_rules(odd).where("doc_id <> 2").collect()}
    assert not any(r["kept"] for r in out.values() if r["doc_id"] != 1) and out[3]["n_words"] == 0 and out[6]["n_repeat_words"] == 60_000
    assert rules.apply_rules(empty(odd)).count() == 0
    assert rules.passing(odd).columns == odd.columns


# --- vector search ----------------------------------------------------------


def brute_neighbours(pairs, k=5):
    ids, m = [i for i, _ in pairs], np.array([v for _, v in pairs], dtype=float)
    n = np.sqrt((m * m).sum(1))
    out = {}
    for q in range(len(ids)):
        if ids[q] % 50 == 0:
            s = (m * m[q]).sum(1) / (n * n[q])
            out[ids[q]] = sorted(((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q]))[:k]
    return out


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in common.table(spark, sf, "embeddings").collect()])
    got: dict[int, list] = {}
    for r in ann.op4_inverted_multi_index(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = sum(len({v for v, _ in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        exact = {v: -s for s, v in want[q]}
        assert all(s == pytest.approx(exact[v], abs=1e-12) for v, s in found if v in exact)


def test_neighbours_ties_invalid_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (50, [0.0, 1.0]), (10, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "score": F.lit("y"), "first": F.lit(1)})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (50, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 0)]
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_crowded_cell_is_split_into_blocks(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(1.0)).alias("embedding"))
    got = ann.search(df, F.col("vec_id") % 50 == 0, block=64).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(7), rng.random(5)
    order = [d1[a] + d2[b] for a, b in ann.traverse(d1, d2, np.ones((7, 5), dtype=int), np.inf)]
    assert len(order) == 35 and order == sorted(order)


# --- quality classifier -----------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    doc, score, move = np.array([0, 0, 0, 0, 1, 2, 2]), rng.normal(size=7), rng.normal(size=(2, 2))
    good, joint, log_z, _ = crf.marginals(score, move, doc, pairs=True)
    want, total, pair = np.zeros(7), 0.0, np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z, by, two = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            p = math.exp(sum(score[i] for i, v in zip(at, y) if v) + sum(move[a, b] for a, b in zip(y, y[1:])))
            z += p
            by += p * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += p
        want[at], total, pair = by / z, total + math.log(z), pair + two / z
    assert good == pytest.approx(want) and log_z == pytest.approx(total) and joint == pytest.approx(pair)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = crf.op5_crf_quality(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (out.predicted == out.quality).mean() > 0.98 and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_features_do_not_depend_on_the_batch():
    texts = ["A line.\nMORE!! LINES!!\n", "", "été | à |\n\n x x x", "$$$ a*** b"]
    together = crf.line_features(texts)
    apart = [crf.line_features([t]) for t in texts]
    assert together.x == pytest.approx(np.concatenate([a.x for a in apart])) and together.doc.tolist() == [0, 0, 1, 2, 2, 3]


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    out = crf.quality_scores(odd, labels).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["kept"] == "mine" for r in out)
    assert {r["score"] for r in crf.quality_scores(odd, empty(labels)).collect()} == {0.5}
    assert crf.quality_scores(empty(odd), labels).count() == 0


# --- near duplicates --------------------------------------------------------


def brute_components(rows, width, percent=80):
    def shingles(t):
        w = words_of((t or "").translate(LOWER))
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    want = brute_components(rows, width)
    for r in neardup.near_duplicates(documents(spark), width=width).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("options", [{}, {"longest_list": 2, "k": 24}])
def test_near_duplicates_of_edited_groups(spark, options):
    """Chains of edits, a common passage and a crowd of near copies."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(90)] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]) for _ in range(60)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["one", "one", "ONE", "", None, "a b", "a b"]
    rows = list(enumerate(texts))
    want = brute_components(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_components_both_ways(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 3), (3, 100), (7, 7), (200, 201)]
    for most in (neardup.ONE_TASK, 0):
        monkeypatch.setattr(neardup, "ONE_TASK", most)
        got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_texts_are_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    want = sorted(neardup.near_duplicates(documents(spark)).collect())
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert sorted(neardup.near_duplicates(documents(spark)).collect()) == want


def test_near_duplicates_of_odd_rows(spark, odd):
    out = neardup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 11 and by[2]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[3]["kept"] and by[None]["kept"]
    assert neardup.near_duplicates(empty(odd)).count() == 0
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]


# --- packing ----------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        longest = np.sort(rng.choice(np.arange(1, 60), n, replace=False))
        counts = rng.integers(1, 20, n)
        for k in (1, 2, 3, 9):
            bounds, padding = packing.best_boundaries(longest, counts, longest * counts, k)
            cost = lambda cut: sum(c * (min(b for b in cut if b >= x) - x) for x, c in zip(longest, counts))  # noqa: B023, E731
            best = min(cost((*c, longest[-1])) for m in range(min(k, n)) for c in itertools.combinations(longest[:-1], m))
            assert len(bounds) <= k and cost(bounds) == padding == best
    assert packing.best_boundaries(*(np.array([], dtype=int),) * 3, 4) == ([], 0)


def test_packing_places_every_document(spark):
    out = packing.op7_length_packing(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert sorted(out.doc_id) == sorted(texts) and all(r.length == len(words_of(texts[r.doc_id])) + 1 for r in out.itertuples())
    assert (out.padding >= 0).all() and (out.boundary - out.length == out.padding).all()
    for (bucket, batch), g in out.groupby(["bucket", "batch"]):
        assert sorted(g.place) == list(range(len(g))) and (g.boundary.sum() <= 65_536 or len(g) == 1)
    for _, g in out.groupby("bucket"):
        assert g.boundary.nunique() == 1 and g.length.max() == g.boundary.iloc[0] and sorted(g.slot) == list(range(len(g)))


def test_packing_of_odd_rows(spark, odd):
    out = packing.pack_documents(odd, n_buckets=3, token_budget=1000).toPandas()
    assert len(out) == 11 and out.length.min() == 1 and out[out.length > 1000].groupby("batch").size().max() == 1
    assert packing.pack_documents(empty(odd)).count() == 0


# --- language ---------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op8_hyperdimensional_language(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_gram_vectors_are_bound_permutations():
    space = langid.Space(dims=64)
    one, grams = space.letters().astype(int), space.grams()
    a, b, c = 3, 7, 0
    assert (grams[(a * 40 + b) * 40 + c] == np.roll(one[a], 2) * np.roll(one[b], 1) * one[c]).all()
    got, n = langid.gram_counts("Ab, ab!", langid.symbol_table())
    assert dict(zip(got.tolist(), n.tolist())) == {(0 * 40 + 1) * 40 + 2: 2, (1 * 40 + 2) * 40: 2, (2 * 40) * 40 + 1: 1}


def test_language_of_odd_rows(spark, odd):
    made = langid.profiles(odd)
    assert list(made) == ["de", "en", "fr"]
    out = {r["doc_id"]: r for r in langid.identify(odd, made).collect()}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[5]["lang_pred"] == "und" and out[None]["lang_pred"] == "fr" and out[1]["source"] == "a"
    assert {r["lang_pred"] for r in langid.identify(odd, langid.profiles(empty(odd))).collect()} == {"und"}
    assert langid.identify(empty(odd), made).count() == 0


# --- mixing -----------------------------------------------------------------


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450.0, 2.0) == pytest.approx([200, 250 * 2 / 3, 250 / 3])
    assert mixing.targets([10, 0, 10], [1, 1, 1], 100.0, 2.0) == [20.0, 0.0, 20.0]
    assert mixing.targets([], [], 0.0, 2.0) == []


def test_mix_meets_targets_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.1"
    out = mixing.op9_source_mixing(spark, sf).toPandas()
    texts = {r["doc_id"]: (len(words_of(r["text"])), r["source"]) for r in documents(spark, sf).collect()}
    assert len(out) == len(texts) and all((r.size, r.source) == texts[r.doc_id] for r in out.itertuples())
    assert (out.taken <= 2 * out["size"]).all() and set(out.copies) <= {0, 1, 2}
    g = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((g.taken - g.target).abs() <= g.most / 2 + 1e-6).all() and g.target.sum() == pytest.approx(1.5 * out["size"].sum())
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    again = mixing.op9_source_mixing(spark, sf).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()


def test_reduction_tree_of_many_chunks(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("b")).alias("source"), (F.col("id") % 17 + 1).alias("size"))
    out = mixing.mix(df, rows_per_chunk=10, fan_in=8).toPandas()
    assert len(out) == 3000
    for _, g in out.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 17


def test_pivot_keeps_expectations():
    size, part = np.array([5, 3, 8, 1, 4]), np.array([0.3, 0.6, 0.5, 0.2, 0.7])
    runs = np.array([mixing._pivot(size, part, np.random.default_rng(s)) for s in range(4000)])
    assert runs.mean(axis=0) == pytest.approx(part, abs=0.03)
    assert (runs * size).sum(axis=1) == pytest.approx(np.full(4000, (part * size).sum()))
    assert (((runs > 1e-9) & (runs < 1 - 1e-9)).sum(axis=1) <= 1).all()


def test_mix_of_odd_rows(spark, odd):
    docs = odd.select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    out = mixing._each_row(mixing.mix(docs)).collect()
    assert len(out) == 11 and all(r["copies"] * r["size"] <= 2 * r["size"] for r in out)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.where("doc_id = 2").count() <= 4
    assert mixing.mix(empty(docs)).count() == 0 and mixing.mix_documents(empty(odd)).count() == 0


# --- likelihood -------------------------------------------------------------


def test_marginal_is_the_sum_over_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [lattice.WORD_MARK, b"ab", b"abc", b"bc", lattice.WORD_MARK + b"a"]
    logp = np.log(np.full(len(pieces), 1 / len(pieces)))
    units, table = lattice.Units(pieces, logp), dict(zip(pieces, logp))

    def segmentations(word):
        if not word:
            return [()]
        return [(word[:i], *rest) for i in range(1, len(word) + 1) if word[:i] in table for rest in segmentations(word[i:])]

    for word in (b"abc", b"a", b"abab", b"\xff"):
        ways = segmentations(lattice.WORD_MARK + word)
        total = sum(math.exp(sum(table[p] for p in way)) for way in ways)
        assert lattice.word_log_probs([word], units)[0] == pytest.approx(math.log(total))
        use = lattice.expected_counts([word], np.array([2.0]), units)
        want = Counter()
        for way in ways:
            for p in way:
                want[p] += 2 * math.exp(sum(table[x] for x in way)) / total
        assert {pieces[i]: use[i] for i in np.flatnonzero(use)} == pytest.approx(dict(want))
    long = b"abc" * 60
    assert lattice.word_log_probs([long], units)[0] == pytest.approx(lattice.forward(units.edges(np.frombuffer(lattice.WORD_MARK + long, dtype=np.uint8)[None]), 1, 183)[183][0])


def test_scores_of_all_documents(spark):
    out = {r["doc_id"]: r for r in lattice.op10_subword_lattice(spark, SF).collect()}
    texts = {r["doc_id"]: lattice.split_words(r["text"]) for r in documents(spark).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in texts.items() if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    assert set(out) == set(texts)
    for i, ws in texts.items():
        r, tokens = out[i], [*ws, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)) and r["score"] < 0


def test_scores_by_small_buckets_are_the_same(spark):
    docs = documents(spark).select("doc_id", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    a = {r["doc_id"]: r for r in lattice.score_documents(docs).collect()}
    b = {r["doc_id"]: r for r in lattice.score_documents(docs, hot_share=50, per_bucket=3000).collect()}
    assert all(a[i]["base_score"] == pytest.approx(b[i]["base_score"]) and a[i]["score"] == pytest.approx(b[i]["score"]) and a[i]["n_known"] == b[i]["n_known"] for i in a)


def test_scores_of_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", (F.col("doc_id") == 9).alias("held_out"))
    out = lattice.score_documents(docs.fillna(False, ["held_out"])).collect()
    assert len(out) == 11 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 5)} == {1} and sum(r["doc_id"] is None for r in out) == 1
    assert lattice.score_documents(empty(docs)).count() == 0


# --- queries ----------------------------------------------------------------


def test_all_ten_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want[order].sort_values(order).reset_index(drop=True), check_dtype=False)
