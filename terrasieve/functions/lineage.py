"""Cutting the lineage of iterative plans, in a folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A session on one machine that
    names none gets a temporary folder; on a cluster that is an error, as the
    executors would not see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="terrasieve-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    The plan that follows starts from the files: it has their true sizes, and
    neither the steps nor the size estimates of what came before, which double
    their digits where a table is joined with itself round after round."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder: no Parquet coding, but its
    estimated size stays that of its plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
