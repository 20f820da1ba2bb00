"""Exact nearest rows in feature space, by grids of growing cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settled
from .guards import union_all

#: The first grid is halved until no cell holds more than so many times k rows.
CROWD = 64


def k_nearest(points: DataFrame, key: str, vector: str, k: int = 5, scale: Sequence[float] | None = None) -> DataFrame:
    """The ``k`` nearest others of each row: key, nth (from 1), near (their
    key), near_vector, distance (Euclidean on components divided by ``scale``;
    ties to the smaller key). All others, where there are fewer.

    ``key`` is unique and vectors are whole and differ: give equal ones once,
    so that a value that many rows share is not paired with itself. Rows meet
    in cells of the two components with the most values; a row that has not k
    others within one cell's width goes on with twice the width.
    """
    p = settled(points.select(F.col(key).alias("key"), F.col(vector).alias("v")))
    n, first = p.count(), p.select(F.size("v").alias("d")).first()
    d = first["d"] if first else 0
    scale = [float(s) or 1.0 for s in (scale or [1.0] * d)]
    at = lambda v, i: F.col(v)[i] / scale[i]
    found = [p.select("key", F.lit(0).alias("nth"), F.col("key").alias("near"), F.col("v").alias("near_vector"), F.lit(0.0).alias("distance")).where("false")]
    if n > 1:
        of = p.agg(*[f(at("v", i)).alias(f"{name}{i}") for i in range(d) for name, f in (("lo", F.min), ("hi", F.max), ("nv", F.approx_count_distinct))]).first()
        axes = sorted(sorted(range(d), key=lambda i: (-of[f"nv{i}"], i))[:2])
        whole = math.sqrt(sum((of[f"hi{i}"] - of[f"lo{i}"]) ** 2 for i in range(d))) or 1.0
        spans = [of[f"hi{i}"] - of[f"lo{i}"] for i in axes if of[f"hi{i}"] > of[f"lo{i}"]]
        width = min(whole, math.prod(s * (k / n) ** (1 / len(spans)) for s in spans) ** (1 / max(len(spans), 1)) if spans else whole)
        cells = lambda w: [F.floor((at("v", i) - of[f"lo{i}"]) / w).cast("long").alias(f"_c{i}") for i in axes]
        names = [f"_c{i}" for i in axes]
        while width > whole * 2.0**-40 and p.groupBy(*cells(width)).count().agg(F.max("count")).first()[0] > CROWD * k:
            width /= 2
        rest, wanted = p, min(k, n - 1)
        nth = F.row_number().over(Window.partitionBy("key").orderBy("d2", "near"))
        while True:
            last = width >= whole
            around = p.select(F.col("key").alias("near"), F.col("v").alias("near_vector"), *cells(width))
            for c in names:
                around = around.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
            d2 = sum(((at("v", i) - at("near_vector", i)) ** 2 for i in range(d)), F.lit(0.0))
            met = rest.select("key", "v", *cells(width)).join(around, names).where(F.col("key") != F.col("near")).select("key", "near", "near_vector", d2.alias("d2"))
            met = met if last else met.where(F.col("d2") <= width * width)
            near = settled(met.withColumn("nth", nth).where(F.col("nth") <= wanted))
            full = near.where(F.col("nth") == wanted).select("key")
            found.append(near.join(full, "key", "left_semi").select("key", "nth", "near", "near_vector", F.sqrt("d2").alias("distance")))
            rest = settled(rest.join(full, "key", "left_anti"))
            if last or rest.isEmpty():
                break
            width = min(2 * width, whole)
    return union_all(found).withColumnRenamed("key", key)
