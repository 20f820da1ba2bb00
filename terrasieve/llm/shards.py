"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _best(keys: Sequence[Column], weights: Sequence[float], first: int = 0) -> Column:
    """struct(cost, shard) of the shard that wins a key.

    Each (key, shard) pair gives a uniform number u in (0, 1); the smallest
    ``-ln(u) / weight`` wins, which takes each shard in proportion to its
    weight. Equal costs go to the smaller shard.
    """
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def cost(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*keys, s["shard"]), 11).cast("double") + 0.5) * 2.0**-53
        return F.struct((-F.log(u) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, cost))


def assign_shards(
    df: DataFrame, keys: Sequence[str], weights: Sequence[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard"
) -> DataFrame:
    """Add the shard of each row, and the shard it would have with one more.

    The columns ``keys`` and the weights decide alone: equal keys meet in one
    shard, and a further shard takes rows only into itself. It is a
    projection without a shuffle. A null key part is left out of the hash, so
    that rows whose keys are all null share a shard. ``df`` keeps all its
    columns but those named ``shard`` and ``grown``, which are replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    cols = [df[k] for k in keys]
    out = df.withColumns({"_best": _best(cols, weights)} | ({} if grown_weight is None else {"_new": _best(cols, [grown_weight], len(weights))}))
    out = out.withColumn(shard, F.col("_best.shard"))
    if grown_weight is not None:
        out = out.withColumn(grown, F.when(F.col("_new.cost") < F.col("_best.cost"), F.col("_new.shard")).otherwise(F.col("_best.shard")))
    return out.drop("_best", "_new")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """All documents in ``n_shards`` equal shards by doc_id (law ``key``).

    A null text has size 16 and the checksum 0 of no bytes. Repeated rows go
    to one shard, each with a slot of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = common.table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    sharded = common.settled(assign_shards(rows, ["doc_id"], [1.0] * n_shards, grown_weight=1.0))
    return common.number_slots(sharded, "shard", ["doc_id", "text_crc32", "row_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
