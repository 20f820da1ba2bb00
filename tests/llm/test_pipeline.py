"""Each stage on its own input against a plain version, and the whole run."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from terrasieve.llm import common, crf, mixing

from .test_operators import brute_components, plain_measures, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, then the output of each stage, written and read again."""
    out = [common.table(spark, SF, "documents")]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_and_columns(tables):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "source_mixing", "length_packing"]
    assert all(t.columns == list(pipeline.COLUMNS) for t in tables[:5])


def test_classifier_keeps_what_it_predicts_good(spark, tables):
    good = {r["doc_id"] for r in crf.op5_crf_quality(spark, SF).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in rows(tables[1])} == good
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in good for i in clean) / len(clean) > 0.97


def test_rules_drop_what_breaks_them(tables):
    kept = {r["doc_id"] for r in rows(tables[2])}
    for r in rows(tables[1]):
        n, *_, repeated = plain_measures(r["text"])
        assert r["doc_id"] not in kept or (n >= 50 and 100 * repeated <= 50 * n)
    lost = [r for r in rows(tables[1]) if r["doc_id"] not in kept]
    assert sum(plain_measures(r["text"])[0] >= 50 for r in lost) <= 0.05 * len(rows(tables[1]))


def test_one_of_each_group_stays(tables):
    components = brute_components([(r["doc_id"], r["text"]) for r in rows(tables[2])], 5)
    assert sorted(r["doc_id"] for r in rows(tables[3])) == sorted({c for _, c in components.values()})


def test_mixing_repeats_whole_documents(tables):
    before, after = {r["doc_id"]: r for r in rows(tables[3])}, rows(tables[4])
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and all(r == before[r["doc_id"]] for r in after)
    sources = sorted({r["source"] for r in before.values()})
    size = {s: sum(len(words_of(r["text"])) for r in before.values() if r["source"] == s) for s in sources}
    aims = mixing.targets(list(size.values()), [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(size.values()), 2.0)
    for s, aim in zip(sources, aims):
        taken = sum(len(words_of(r["text"])) for r in after if r["source"] == s)
        assert abs(taken - aim) <= max(len(words_of(r["text"])) for r in before.values() if r["source"] == s) / 2 + 1e-6


def test_packing_places_every_copy(tables):
    assert Counter(r["doc_id"] for r in rows(tables[5])) == Counter(r["doc_id"] for r in rows(tables[4]))


def test_run_gives_the_stages_result(spark, tables):
    got = pipeline.run(spark, SF)
    assert got.columns == tables[5].columns and sorted(r["doc_id"] for r in rows(got)) == sorted(r["doc_id"] for r in rows(tables[5]))


def test_stages_take_an_empty_table_and_extra_columns(spark, tables):
    odd = tables[0].where("false").withColumnsRenamed({}).selectExpr("*", "'x' as score", "'y' as kept", "1 as size")
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, SF).count() == 0


def without_folders(tmp_path):
    """A copy of the repository without the corpus folders, and the caller's
    environment with the copy first on its path."""
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    path = os.pathsep.join([str(tmp_path / "copy"), *filter(None, [os.environ.get("PYTHONPATH")])])
    return tmp_path / "copy", os.environ | {"PYTHONPATH": path}


def test_the_rest_works_without_these_folders(tmp_path):
    """All other tests are found, which imports all they use; the operators'
    own tests and a few queries run, and stand for the rest."""
    copy, env = without_folders(tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=copy, check=True, env=env, stdout=subprocess.DEVNULL)
    some = ["tests/test_oracle.py", "tests/test_operators.py", "-k", "entry or group_folds or row_positions or guards or cohen or folds"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *some], cwd=copy, check=True, env=env)


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'op2_fuzzy_license_scan' not in q and 'recipe_metrics' in q"
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), str(root), *filter(None, [os.environ.get("PYTHONPATH")])])}
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=env)
