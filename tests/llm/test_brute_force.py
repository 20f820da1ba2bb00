"""op5, op8 and op10 against plain versions on a small table, by their queries."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from functools import lru_cache
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasieve.llm import crf, langid, lattice, part_queries

TEXTS = [
    "The cat sat. On the mat!\nTHE cat sat | on # mats\n\nok ok ok",
    "Der Hund läuft über die Straße. Schön!",
    "le garçon est là\nle garçon est là\n12 34 | 5",
    "ПРИВЕТ мир, привет",
    "",
    None,
    "BUY NOW!!! BUY NOW!!!\n### $$$ %%\nclick | click | click",
    "naïve 日本 text\twith\x0btabs \U0001d4d0",
    "one",
    "the the the\nend of it. the end of it.",
]
LANGS = ["en", "de", "fr", "ru", "en", "fr", "en", None, "en", "en"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("small")
    rows = [(10 * k + i, t, lang) for k in range(3) for i, (t, lang) in enumerate(zip(TEXTS, LANGS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(d, int(d % 10 not in (6, 2)), 0) for d, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root), rows


@pytest.mark.parametrize("name", sorted(part_queries.ORACLE_SQL))
def test_plain_columns_match_sql(spark, name):
    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = part_queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(part_queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want[order].sort_values(order).reset_index(drop=True), check_dtype=False)


def held(doc_id: int, modulus: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def plain_line(line: str, before: list[str], pairs: list[tuple]) -> list[float]:
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    solid = "".join(words)
    n, chars = max(len(words), 1), max(len(solid), 1)
    count = lambda kind: sum(c in kind for c in line)
    upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
    repeats, last = 0, before[-1] if before else None
    for w in words:
        repeats += (last, w) in pairs
        pairs.append((last, w))
        last = w
    twins = sum(a == b for a, b in zip(words, words[1:]))
    return [
        1.0, min(count("#*$%&<>") / n, 3), min(count("!") / n, 3), min(count("|") / n, 2), upper / chars, lower / chars, count("0123456789") / chars, min(count(".,;:?") / n, 2),
        twins / n, repeats / n, min(len(solid) / n, 20) / 5, min(math.log1p(len(words)), 6) / 3, float(upper > 0.5 * chars), float("|" in line), float(line[-1:] in (".", "!", "?") and line != ""),
    ]


def plain_quality(text: str | None, model: crf.Model) -> float:
    rows, lengths, before, pairs = [], [], [], []
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if words:
            rows.append(plain_line(line, before, pairs))
            lengths.append(len("".join(words)))
            before += words
    if not rows:
        rows, lengths = [plain_line("", [], [])], [1]
    zero = [0.0] * crf.N_FEATURES
    score = [np.dot(model.weight, rows[i] + (rows[i - 1] if i else zero) + (rows[i + 1] if i + 1 < len(rows) else zero)) for i in range(len(rows))]
    total, good = 0.0, np.zeros(len(rows))
    for labels in itertools.product((0, 1), repeat=len(rows)):
        weight = math.exp(sum(s for s, y in zip(score, labels) if y) + sum(model.move[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
    mean = float(np.dot(good / total, lengths) / sum(lengths))
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.shift)))


def test_op5_against_enumerated_labels(spark, small):
    root, rows = small
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    known = [d for d, _, _ in rows if not held(d, 5, 0)]
    model = crf.train(docs.select("doc_id", "text"), labels.where(F.col("doc_id").isin(known)))
    got = {r["doc_id"]: r for r in crf.op5_crf_quality(spark, root).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        want = plain_quality(text, model)
        assert got[d]["score"] == pytest.approx(want, abs=1e-6) and got[d]["held_out"] == held(d, 5, 0)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.3)


def test_op8_against_plain_vectors(spark, small):
    root, rows = small
    space = langid.Space()
    vectors, letters = langid.Vectors(space), space.letters()

    def of(symbol: str) -> np.ndarray:
        if symbol == " ":
            return letters[0].astype(float)
        return (letters[ord(symbol) - 96] if "a" <= symbol <= "z" else vectors.letter(ord(symbol))).astype(float)

    def bundle(text: str | None) -> np.ndarray | None:
        plain = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not plain.strip():
            return None
        s = " " + re.sub(" +", " ", plain).strip() + " "
        return sum(np.roll(of(a), 2) * np.roll(of(b), 1) * of(c) for a, b, c in zip(s, s[1:], s[2:]))

    sums: dict[str, np.ndarray] = {}
    for d, text, lang in rows:
        v = bundle(text)
        if lang and v is not None and not held(d, 4, 2):
            sums[lang] = sums.get(lang, 0) + v
    got = {r["doc_id"]: r for r in langid.op8_hyperdimensional_language(spark, root).collect()}
    assert len(got) == len(rows) and len(sums) > 2
    for d, text, _ in rows:
        v = bundle(text)
        if v is None:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        cosine = {name: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for name, p in sums.items()}
        assert cosine[got[d]["lang_pred"]] == pytest.approx(max(cosine.values()), abs=1e-5)
        assert got[d]["score"] == pytest.approx(max(0.0, max(cosine.values())), abs=1e-4)


def test_op10_against_enumerated_segmentations(spark, small):
    root, rows = small
    docs = spark.read.parquet(f"{root}/documents.parquet").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    n_train = sum(not held(d, 7, 2) for d, _, _ in rows)
    units, end = lattice.learn_units(lattice.count_words(docs), n_train)
    table = dict(zip(units.pieces, units.logp))

    @lru_cache(maxsize=None)
    def whole(word: bytes) -> float:
        """Probability summed over all ways to cut the word."""
        return 1.0 if not word else sum(math.exp(table[word[:k]]) * whole(word[k:]) for k in range(1, len(word) + 1) if word[:k] in table)

    for r in lattice.op10_subword_lattice(spark, root).collect():
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        words = lattice.split_words(text)
        want = (sum(math.log(whole(lattice.WORD_MARK + w)) for w in words) + end) / math.log(10)
        assert r["score"] == pytest.approx(want, rel=1e-6) and r["n_tokens"] == len(words) + 1
