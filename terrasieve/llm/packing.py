"""Packing: optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def best_boundaries(longest: np.ndarray, counts: np.ndarray, sums: np.ndarray, n_buckets: int) -> tuple[list[int], int]:
    """Boundaries (bucket maxima, ascending) of least total padding, and it.

    Bins come in ascending order with the longest length, the row count and
    the sum of lengths of each. ``best[k][j]``, the least padding of the first
    j bins in k buckets, follows from ``best[k-1]`` by the choice of the last
    bucket's first bin; ties take the fewest and then the lowest boundaries.
    That bin does not fall as j grows, so halving the rows j takes n log n steps.
    """
    n = len(longest)
    if not n:
        return [], 0
    rows, tokens = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (counts, sums))
    last = np.arange(1, n + 1)
    cost = longest[last - 1] * rows[last] - tokens[last]  # one bucket from bin 0
    best, choice = cost, []
    totals = [int(best[-1])]
    for k in range(1, min(n_buckets, n)):
        new, cut = best.copy(), np.full(n, -1, dtype=np.int64)
        spans = [(1, n - 1, 1, n - 1)]  # rows j and the first bins i that they may choose
        while spans:
            a, b, lo, hi = spans.pop()
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j) + 1)  # bins i..j form the last bucket
            padded = best[i - 1] + longest[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
            at = int(padded.argmin())
            if padded[at] < best[j]:
                new[j], cut[j] = padded[at], i[at]
            if a < j:
                spans.append((a, j - 1, lo, int(i[at])))
            if j < b:
                spans.append((j + 1, b, int(i[at]), hi))
        choice.append(cut)
        best = new
        totals.append(int(best[-1]))
    bounds, j, k = [], n - 1, len(choice)
    while k > 0:
        cut = choice[k - 1][j]
        if cut >= 0:
            bounds.append(int(longest[j]))
            j = int(cut) - 1
        k -= 1
    bounds.append(int(longest[j]))
    return bounds[::-1], totals[-1]


def pack(df: DataFrame, length: str, order: list[str], n_buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """Give each row a length bucket and a batch within it.

    The exact histogram (a row for each different length) is all that reaches
    the driver; dynamic programming over it chooses the boundaries of least
    padding. Rows are padded to their bucket's boundary, and
    ``max(1, token_budget // boundary)`` of them make a batch, so only a row
    that is itself over the budget makes a batch over it. Null lengths count
    as 0; lengths 0 fall into the first bucket. Adds bucket, boundary,
    padding, slot (from 0 in the bucket), batch (from 0 in the bucket) and
    place (from 0 in the batch). ``df`` must hold what ``order`` names to tell
    rows apart; give a unique row id for rows that may repeat.
    """
    rows = common.settled(df.withColumn(length, F.coalesce(F.col(length), F.lit(0)).cast("long")))
    bins = rows.groupBy(length).agg(F.count("*").alias("n")).orderBy(length).collect()
    longest, n = (np.array([r[c] for r in bins], dtype=np.int64) for c in (length, "n"))
    bounds, _ = best_boundaries(longest, n, longest * n, n_buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucketed = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col(length))).cast("int")).withColumn(
        "boundary", F.get(edges, F.col("bucket"))
    )
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("boundary"), F.lit(1))))
    return common.number_slots(bucketed, "bucket", order).withColumns(
        {
            "padding": F.col("boundary") - F.col(length),
            "batch": F.floor(F.col("slot") / per_batch).cast("long"),
            "place": (F.col("slot") % per_batch).cast("long"),
        }
    )


def pack_documents(docs: DataFrame, n_buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """``pack`` of documents by their words plus one end token."""
    lengths = docs.select("doc_id", (common.word_count(F.col("text")) + 1).alias("length"), F.monotonically_increasing_id().alias("row_id"))
    return pack(lengths, "length", ["doc_id", "row_id"], n_buckets, token_budget).select(
        "doc_id", "length", "bucket", "boundary", "padding", "slot", "batch", "place"
    )


def op7_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 optimal length buckets and batches of 65,536 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
