"""Letters other than a to z have vectors of their own."""

from __future__ import annotations

import numpy as np

from terrasieve.llm import langid


def test_each_letter_is_told_apart():
    table = langid.symbol_table()
    letters = "äßéóîöñçâûбжлрхъяє日本語𐐨"
    grams = [langid.gram_counts(x, table)[0] for x in letters]
    assert len({tuple(g) for g in grams}) == len(letters)
    vectors = langid.Vectors(langid.Space())
    one = np.concatenate([vectors.of(g) for g in grams]).astype(int)
    assert (np.abs(one @ one.T - 1024 * np.eye(len(letters), dtype=int)) < 200).all()
    mixed = langid.gram_counts("aж", table)[0]
    a, zh, gap = vectors.letter(1), vectors.letter(ord("ж")), vectors.letter(0)
    want = {tuple(np.roll(x, 2) * np.roll(y, 1) * z) for x, y, z in ((gap, a, zh), (a, zh, gap))}
    assert {tuple(v) for v in vectors.of(mixed)} == want


def test_languages_that_differ_by_shared_letters(spark):
    rows = [(i, x * 40, lang) for i, (x, lang) in enumerate([("б л бл лб ", "one"), ("ж р жр рж ", "two")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: r["lang_pred"] for r in langid.identify(df, langid.profiles(df)).collect()}
    assert got == {"one": "one", "two": "two"}
