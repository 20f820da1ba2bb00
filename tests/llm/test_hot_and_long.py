"""Hot rows, very long texts, repeated ids, and stages on odd rows."""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from terrasieve.llm import ann, common, crf, licenses, mixing, neardup

from .test_operators import odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_a_text_in_pieces_scores_as_a_whole():
    rng = np.random.default_rng(0)
    model = crf.Model(rng.normal(0, 1, 3 * crf.N_FEATURES), rng.normal(0, 1, (2, 2)))
    words, gaps = ["a", "B!", "cc", "d.", "|", "x#", "yy", "Zz.", "longer-Than!1piece", "longer-Than!1piece", "é日本" * 5], [" ", "\n", " ", "\t", "\n\n", " \n"]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.integers(0, 60)))
        lines = crf.line_features([text])
        whole = crf.document_marginal(lines, crf.with_neighbours(lines), model, 1)[0]
        for most in (5, 13, 40, 1000):
            assert crf.long_marginal(text, model, most) == pytest.approx(whole, abs=1e-9)
    for text in ("x" * 100, "x" * 21 + " " + "x" * 21 + "\n" + "x" * 14, "ab" * 7 + " \n" + "ab" * 7):  # words of many pieces
        lines = crf.line_features([text])
        assert crf.long_marginal(text, model, 7) == pytest.approx(crf.document_marginal(lines, crf.with_neighbours(lines), model, 1)[0], abs=1e-9)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = crf.Model(rng.normal(0, 1, 3 * crf.N_FEATURES), rng.normal(0, 1, (2, 2)))
    texts = ["tail x", "y z\nx y z", "x\n\ny y", ""]
    assert crf.score_texts(texts, model) == pytest.approx([crf.score_texts([t], model)[0] for t in texts], abs=1e-12)


def test_the_sample_of_the_classifier_is_bounded(spark):
    docs = spark.range(400).select((F.col("id") % 20).alias("doc_id"), F.concat(F.repeat(F.lit("word "), 20), F.when(F.col("id") % 2 == 1, "END!").otherwise("end")).alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert crf.train(docs, labels, most_chars=50).slope == 1.0  # no text fits: the plain model
    assert np.abs(crf.train(docs, labels).weight).sum() > 0


def test_the_sample_of_the_classifier_is_bounded_by_lines_too(spark, monkeypatch):
    """Texts of very many short lines are what memory goes by."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a\n"), F.when(F.col("id") < 4, 50_000).otherwise(100).cast("int")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(crf, "fit", lambda texts, quality, **_: seen.append(sum(t.count("\n") + 1 for t in texts)))
    crf.train(docs, labels)
    crf.train(docs, labels, most_lines=2000)
    assert seen == [36 * 101, 19 * 101]


def test_rows_that_repeat_an_id_are_one_query_and_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.2]), (7, [1.0, 0.1]), (8, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert len(got) == 3 and Counter(v for _, _, v in got) == {7: 2, 8: 1} and {q for q, _, _ in got} == {0}


def test_a_repeated_row_is_mixed_whole(spark):
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(3).alias("n_chars"))
    rest = spark.range(100).select((F.col("id") + 10).alias("doc_id"), F.concat_ws(" ", F.lit("some words here"), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "b").alias("source"), F.lit(9).alias("n_chars"))
    docs = hot.unionByName(rest)
    mixed = mixing.mix_documents(docs, block=100)
    sizes = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    want = {r["doc_id"]: r["c"] for r in mixing._each_row(mixing.mix(sizes)).groupBy("doc_id").agg(F.sum("copies").alias("c")).where("c > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and got[1] == want[1] and got[1] % 3000 != 0
    taken = {r["source"]: r["s"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("s")).collect()}
    assert taken["b"] <= 2 * 50 * 4 and taken[None] <= 2 * 50 * 4


def test_one_row_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "quite another text of some words"), (2, "a b c d e f g"), (3, None), (None, "x y"), (None, "x y")], "doc_id long, text string")
    out = [tuple(r) for r in neardup.deduplicate(docs).collect()]
    assert sorted(Counter(d for d, _ in out).items(), key=str) == [(1, 1), (3, 1), (None, 2)]


def test_stages_take_odd_rows(spark, odd, tmp_path):  # noqa: F811
    docs, ids = odd, {r["doc_id"] for r in odd.collect()}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        for source in (odd, docs):
            out = stage(spark, source, SF)
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
            assert i == len(pipeline.STAGES) - 1 or out.columns == list(pipeline.COLUMNS)
        if i < len(pipeline.STAGES) - 1:
            stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
            docs = spark.read.parquet(str(tmp_path / str(i)))
    assert pipeline.near_dedup(spark, odd, SF).where("doc_id is null").count() == 1
    assert pipeline.length_packing(spark, odd, SF).count() == odd.count()


def test_licences_in_texts_without_spaces():
    """Seeds inside words of any length cost a bounded window, and notices
    beside such words are found."""
    scanner = licenses.Scanner(licenses.NOTICES)
    long_word = "mitlicense" * 40_000 + "gnugeneral" * 10_000
    began = time.perf_counter()
    n, found = scanner.scan(f"{long_word} mit license {long_word} gnu genral public license {long_word}")
    assert time.perf_counter() - began < 60 and n == 9
    assert [(m[1], m[2], m[4]) for m in found if m[1] in ("mit", "gpl")] == [("mit", 1, 0), ("gpl", 4, 1)]
    assert scanner.verify.cache_info().currsize <= 20_000
