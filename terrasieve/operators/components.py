"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled

#: Up to so many different edges (16 bytes each) are finished in one task.
ONE_TASK = 500_000


def _stars(edges: DataFrame) -> DataFrame:
    """One round over different edges (u > v): every larger neighbour of a
    node points to the least of its neighbours and itself, then every smaller
    neighbour to the least of those."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    met = large.join(least, "u")
    small = met.select("u", F.col("m").alias("v")).unionByName(met.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges in order, and the least node each one reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if held:
        edges = pd.concat(held)
        node, component = least_reached(edges["u"].to_numpy(), edges["v"].to_numpy())
        yield pd.DataFrame({"node": node, "component": component})


def connected(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK, settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Nodes are whole numbers; an edge with a null end is none. Rounds of stars
    go on until no edge changes; each is settled, and a count and a sum of
    hashes are all that reaches the driver. The distance to a component's
    least node shrinks by half or better each round. Up to ``one_task`` edges
    (a checked bound of some 8 MB) are finished by one task instead, whose
    rows are dealt out again."""
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    now = settle(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())  # a loop is a node alone
    last = mark(now)
    if last[0] <= one_task:
        return now.coalesce(1).mapInPandas(_finished, "node long, component long").repartition("node")
    loops, now = now.where("u = v").select(F.col("u").alias("node")), now.where("u <> v")
    while last[0]:
        now = settle(_stars(now))
        new = mark(now)
        if new == last:
            break
        last = new
    pairs = now.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))).distinct()
    return pairs.unionByName(loops.join(pairs, "node", "left_anti").select("node", F.col("node").alias("component")))
