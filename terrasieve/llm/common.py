"""Pieces that several corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lineage

#: ASCII white space, which parts words everywhere but in the licence scan.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, all else as it is; null gives an empty text."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def words(col: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    inner = F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def word_count(col: Column) -> Column:
    return F.size(words(col)).cast("long")


def crc_bucket(col: Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


#: ``df`` checkpointed to the session's shared folder, so that later reads see
#: the same rows and a lost executor costs no recomputation.
settled = lineage.checkpointed


def number_slots(df: DataFrame, group: str, order: list[str], slot: str = "slot", rows_per_bucket: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without a gap.

    ``df`` must be settled: it is read twice. Rows are dealt into hashed
    buckets of about ``rows_per_bucket`` rows over all groups, so that a group
    with a third of the table is numbered by many tasks; a running sum of the
    bucket counts gives each bucket's first number. ``order`` names columns
    that tell rows apart (a unique row id among them); its hash sets the order.
    """
    n_buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "_bucket")
        .count()
        .select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        dealt.join(starts, dealt[group].eqNullSafe(starts["_group"]) & (dealt["_bucket"] == starts["_b"]))
        .withColumn(slot, (F.row_number().over(within) - 1 + F.col("_start")).cast("long"))
        .drop("_bucket", "_group", "_b", "_start")
    )


def join_by_class(df: DataFrame, classes: DataFrame, keys: list[str], size: str, rows: int, how: str = "inner", most: int = 4096) -> DataFrame:
    """``df`` joined with ``classes`` (unique by ``keys``, whose column
    ``size`` tells how many rows of ``df`` hold the key).

    Classes of at least ``rows`` / ``most`` rows, of which there are ``most``
    at most, are broadcast, so that the rows of a hot class stay where they
    are; all others meet by shuffle."""
    big = F.col(size) * most >= rows
    hot, cold = classes.where(big).drop(size), classes.where(~big).drop(size)
    rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return df.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys, how))
