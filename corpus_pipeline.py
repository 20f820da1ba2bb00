"""A corpus pipeline: classify, apply rules, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; further columns are left out and may clash.

Odd rows, for every stage: an empty table gives an empty one. A null text
counts as an empty one: it has no words, so the rules reject it, and where it
comes to the later stages it is linked with nothing, has size 0 and length 1.
A null doc_id is no key: such rows are scored, kept or rejected by their text
like others, never dropped as duplicates. A null lang or n_chars decides
nothing; a null source is a source of its own. Texts of any length are taken
whole. Equal rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasieve.functions import lineage
from terrasieve.llm import common, crf, mixing, neardup, packing, rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model predicts to be good (score from 0.3);
    rows that repeat a doc_id are judged each by its own text."""
    scored = crf.quality_scores(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule; texts under 50 words break one."""
    return rules.passing(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group over 5-word shingles, that of
    the smallest doc_id; of rows that repeat a doc_id one stays."""
    return neardup.deduplicate(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; equal rows share
    their copies evenly, and rows of size 0 stay as often as their source's
    share says, up to the whole below."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's length bucket, batch and place; equal copies are told apart
    by their row."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between them go to the shared
    checkpoint folder."""
    home = lineage.scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The learned classifier and the random rounding are beyond SQL; the tests
#: hold each stage against a plain version instead.
ORACLE_SQL = None
