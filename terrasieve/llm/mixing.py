"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fractions this near to 0 or 1 count as whole.
TINY = 1e-9

STATE = "doc_id long, source string, size long, n_rows long, chunk long, whole long, part double"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; a target stops at ``most`` times its size and
    the excess is shared by weight among the rest until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_ and left > 0:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def _pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One pass of weighted pivotal rounding: at most one entry stays fractional.

    Two fractional entries trade expected words at each step: one gives
    a / size and the other takes it, either way round with the chances that
    keep both expectations, until one of them is 0 or 1.
    """
    out = part.copy()
    held = -1
    draws = rng.random(len(part))
    for j in range(len(part)):
        if not TINY < out[j] < 1 - TINY:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        i, wi, wj = held, float(size[held]), float(size[j])
        up = min((1 - out[i]) * wi, out[j] * wj)  # words from j to i
        down = min(out[i] * wi, (1 - out[j]) * wj)  # words from i to j
        move = up if draws[j] * (up + down) < down else -down
        out[i] += move / wi
        out[j] -= move / wj
        for x in (i, j):
            if not TINY < out[x] < 1 - TINY:
                out[x] = round(out[x])
        held = next((x for x in (i, j) if TINY < out[x] < 1 - TINY), -1)
    return out


def _round_groups(df: DataFrame, seed: int, last: bool) -> DataFrame:
    """Round each (source, chunk); ``last`` also takes a source's one residual
    to the nearer whole, which keeps its words nearest to the target. Large documents come first, so that what stays fractional is
    small; sorted rows and a generator seeded by source and chunk make reruns
    agree."""

    def work(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        name = (key[0] or "").encode() + (b"\0" if key[0] is None else b"\1")
        rng = np.random.default_rng([seed, int(key[1]), int(last), *name])
        part = _pivot(pdf["size"].to_numpy(), pdf["part"].to_numpy(float), rng)
        if last:
            part = np.round(part)
        pdf["part"] = part.astype(float)
        return pdf

    return df.groupBy("source", "chunk").applyInPandas(work, STATE)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 9,
    rows_per_chunk: int = 1024,
    fan_in: int = 1024,
) -> DataFrame:
    """Whole copies of each document so that sources meet their targets.

    ``docs`` has the three columns named; others are left out. Sources are a
    bounded catalogue (one row each on the driver), ordered by code point with
    null last; they weigh ``weights``, repeating. A document's expected copies
    are target / source size, at most ``most``; the fractional parts are
    rounded so that each source's words stay at its target but for one
    document. The rounding is a reduction tree: each source's hashed chunks of about
    ``rows_per_chunk`` rows are rounded apart, each leaves one fractional
    residual at most, and ``fan_in`` chunks' residuals meet at the next level.

    Returns one row for each different (doc_id, source, size): n_rows (how
    many rows hold it), source_size, target and copies (of all of them
    together), independent of how the input is partitioned. Null sizes count
    as 0; rows of size 0 get no fraction to round. Empty tables give none.
    """
    rows = common.settled(
        docs.groupBy(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        ).agg(F.count("*").alias("n_rows"))
    )
    by_source = sorted(
        rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("s"), F.count("*").alias("n")).collect(),
        key=lambda r: (r["source"] is None, r["source"] or ""),
    )
    sizes = [r["s"] for r in by_source]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    catalogue = rows.sparkSession.createDataFrame(
        [(r["source"], s, a, a / s if s else 0.0, math.ceil(r["n"] / rows_per_chunk)) for r, s, a in zip(by_source, sizes, aims)],
        "c_source string, source_size long, target double, expected double, chunks int",
    )
    n_chunks = max([1, *(math.ceil(r["n"] / rows_per_chunk) for r in by_source)])
    expected = F.col("expected") * F.col("n_rows")
    state = rows.join(catalogue, rows["source"].eqNullSafe(catalogue["c_source"])).select(
        "doc_id",
        "source",
        "size",
        "n_rows",
        F.pmod(F.xxhash64("doc_id", "size"), F.col("chunks")).cast("long").alias("chunk"),
        F.floor(expected).cast("long").alias("whole"),
        F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(0.0).alias("part"),
    )
    done = []
    while True:
        last = n_chunks == 1
        state = common.settled(_round_groups(state, seed, last))
        done.append(state.where((F.col("part") <= TINY) | (F.col("part") >= 1 - TINY)))
        if last:
            break
        n_chunks = math.ceil(n_chunks / fan_in)
        state = state.where((F.col("part") > TINY) & (F.col("part") < 1 - TINY)).withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.join(catalogue, out["source"].eqNullSafe(catalogue["c_source"])).select(
        "doc_id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.round("part")).cast("long").alias("copies")
    )


def _copies_of(nth: Column) -> Column:
    """Copies of the nth (from 1) of n_rows equal rows, as even as can be."""
    return F.floor(F.col("copies") / F.col("n_rows")) + (nth <= F.col("copies") % F.col("n_rows")).cast("long")


def _each_row(mixed: DataFrame, block: int = 10_000) -> DataFrame:
    """Rows with n_rows above 1 written out again, in blocks so that a key
    with a third of all rows is dealt over the tasks."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(block).cast("long"))
    blocks = mixed.withColumn("_from", F.explode(starts))
    nths = F.sequence(F.col("_from") + 1, F.least(F.col("_from") + block, F.col("n_rows")))
    return blocks.withColumn("_nth", F.explode(nths)).withColumn("copies", _copies_of(F.col("_nth"))).drop("_from", "_nth", "n_rows")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their words, with weights 5, 2, 1."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    return _each_row(mix(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_documents(docs: DataFrame, block: int = 1000) -> DataFrame:
    """Documents repeated or left out as ``mix`` decides; columns unchanged.

    Decisions are made on a narrow table and met again with the texts by a
    hash of the whole row, its source and its size. Equal rows are taken alike
    often, which needs no numbers: each one's whole share, and what then lacks
    of their copies from one of them, dealt out in blocks of ``block``. A row
    that makes more than 1 / 4,096 of the table stays where it is.
    """
    key = ["_row", "_source", "_size"]
    keyed = docs.withColumns({"_row": F.xxhash64(*docs.columns), "_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_size": common.word_count(F.col("text"))})
    mixed = mix(keyed.select("_row", "source", "_size"), doc_id="_row", size="_size").select(
        F.col("doc_id").alias("_row"), F.coalesce("source", F.lit("")).alias("_source"), F.col("size").alias("_size"), "n_rows", "copies"
    )
    mixed = common.settled(mixed.where("copies > 0").select(*key, "n_rows", F.floor(F.col("copies") / F.col("n_rows")).alias("_each"), (F.col("copies") % F.col("n_rows")).alias("_more")))
    total = mixed.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_copy")
    met = common.join_by_class(keyed, mixed.where("_each > 0").select(*key, "_each", "n_rows"), key, "n_rows", total)
    whole = met.select(*docs.columns, times(F.col("_each"))).drop("_copy")
    lacking = mixed.where("_more > 0")
    if lacking.isEmpty():
        return whole
    met = common.join_by_class(keyed, lacking.select(*key, "_more", "n_rows"), key, "n_rows", total)
    one = met.groupBy(*key, "_more").agg(F.first(F.struct(*docs.columns)).alias("_doc"))
    dealt = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_more") - 1, F.lit(block).cast("long")))).repartition(F.xxhash64("_row", "_from"))
    extra = dealt.select("_doc", times(F.least(F.lit(block).cast("long"), F.col("_more") - F.col("_from")))).select("_doc.*")
    return whole.unionByName(extra)
