"""Centroid clustering by Yinyang grouping.

Vectors are turned into whole numbers, so that distances, sums and centroids
are exact. Centroids are put into groups once. Each vector keeps its centroid,
an upper bound of the distance to it and one lower bound for each group; a
round moves the bounds by how far the centroids went and looks again only at
vectors, then groups, then centroids that the bounds leave open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import settled
from . import common

#: Whole components lie within this bound either way; those beyond it count as
#: the bound, as a squared distance of 64 larger ones would leave a long.
BOUND = 2**27
#: Up to here sums of 64 products are exact in double precision.
_DOUBLE = 2**22
_STATE = "vec_id long, x array<int>, cluster int, upper double, lower array<double>"


@dataclass
class Centroids:
    """Whole centroids, the group of each, and how far each went last."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    def to(self, new: np.ndarray) -> Centroids:
        return Centroids(new, self.group, np.sqrt(squares(new, self.at, paired=True).astype(np.float64)) * (1 + 1e-12))

    @property
    def groups(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(self.group.max() + 1)]


def squares(x: np.ndarray, c: np.ndarray, paired: bool = False) -> np.ndarray:
    """Exact squared distances of whole vectors: each x to each c, or row by
    row if ``paired``."""
    if paired:
        return ((x - c) ** 2).sum(axis=-1)
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _DOUBLE and x.shape[1] <= 64:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def grouped(at: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over them."""
    points = at.astype(np.float64)
    heads = points[np.linspace(0, len(points) - 1, min(n_groups, len(points))).astype(int)].copy()
    for _ in range(rounds):
        group = ((points[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(heads)):
            if (group == g).any():
                heads[g] = points[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def assign(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid (ties: smaller number) of each vector, the new
    bounds, and how many distances were computed.

    ``upper`` is at least the distance to ``cluster`` and ``lower`` at most
    that to any other centroid of the group, both before ``c`` moved; a
    cluster of -1 is a vector that was never assigned."""
    groups, scanned = c.groups, 0
    # a margin above rounding: a bound that is too loose costs time only
    lower_now = np.maximum(0, lower - np.array([c.moved[g].max() for g in groups])[None]) * (1 - 1e-12)
    upper_now = np.where(cluster < 0, np.inf, (upper + c.moved[np.maximum(cluster, 0)]) * (1 + 1e-12))
    out_cluster, out_upper, out_lower = cluster.copy(), upper_now.copy(), lower_now.copy()
    open_ = np.flatnonzero(lower_now.min(axis=1) <= upper_now)  # the global filter
    old = cluster[open_]
    fresh = old < 0
    best = np.where(fresh, np.iinfo(np.int64).max, squares(x[open_], c.at[np.maximum(old, 0)], paired=True))
    scanned += int((~fresh).sum())
    nearest, own = np.where(fresh, len(c.at), old), best.copy()
    reach = lambda: np.where(nearest == len(c.at), np.inf, np.sqrt(best.astype(np.float64)) * (1 + 1e-12))
    seen: list[tuple[int, np.ndarray, np.ndarray]] = []  # (group, rows, least distances)
    for g, members in enumerate(groups):
        rows = np.flatnonzero((lower_now[open_, g] <= reach()) | fresh)  # the group filter
        if not len(rows):
            continue
        least = np.full((len(rows), len(members)), np.inf)
        whole = np.full((len(rows), len(members)), np.iinfo(np.int64).max)
        for i, j in enumerate(members):
            bound = np.maximum(0, lower[open_[rows], g] - c.moved[j]) * (1 - 1e-12)
            near = ((bound <= reach()[rows]) | fresh[rows]) & (old[rows] != j)  # the filter of each centroid
            least[:, i] = np.where(old[rows] == j, np.inf, bound)
            if near.any():
                d = squares(x[open_[rows[near]]], c.at[j : j + 1])[:, 0]
                scanned += len(d)
                whole[near, i], least[near, i] = d, np.sqrt(d.astype(np.float64)) * (1 - 1e-12)
                r = rows[near]
                better = (d < best[r]) | ((d == best[r]) & (j < nearest[r]))
                best[r[better]], nearest[r[better]] = d[better], j
        seen.append((g, rows, least))
    for g, rows, least in seen:
        members = groups[g]
        rest = np.where(members[None] == nearest[rows][:, None], np.inf, least)
        out_lower[open_[rows], g] = rest.min(axis=1)
    left = np.flatnonzero(~fresh & (nearest != old))  # the centroid that was left counts for its group again
    g_old = c.group[np.maximum(old[left], 0)]
    out_lower[open_[left], g_old] = np.minimum(out_lower[open_[left], g_old], np.sqrt(own[left].astype(np.float64)) * (1 - 1e-12))
    out_cluster[open_], out_upper[open_] = nearest, reach()
    return out_cluster, out_upper, out_lower, scanned


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly
    ``dims`` components, none of them null or not finite."""
    v = F.col("_x")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_x"))
    kept = kept.where(F.coalesce((F.size(v) == dims) & F.forall(v, fine), F.lit(False)))
    bounded = lambda x: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.lit(float(scale)) * x))
    return kept.select("vec_id", F.transform(v, lambda x: F.floor(bounded(x)).cast("int")).alias("x"))


def _passed(state: DataFrame, c: Centroids, dims: int) -> DataFrame:
    """One assignment of all vectors, batch by batch."""
    n_groups = int(c.group.max()) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_groups)
            cluster, upper, lower, _ = assign(x, c, b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy(), lower)
            ends = pa.array(np.arange(0, len(x) * n_groups + 1, n_groups, dtype=np.int32))
            bounds = pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), bounds], ["vec_id", "x", "cluster", "upper", "lower"])

    return settled(state.mapInArrow(work, _STATE))


def _means(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """Exact floor(sum / count) of each centroid's vectors; an empty one stays."""
    dims = at.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)])
    new = at.copy()
    for r in sums.collect():  # a row for each centroid
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return new


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64, n_groups: int | None = None
) -> tuple[DataFrame, Centroids | None]:
    """Each kept vector's vec_id, x, cluster and exact squared distance, and
    the final centroids (None without vectors).

    The first centroids are the ``k`` kept vectors with the smallest
    lowercase-hex sha256 of ``<seed>:<vec_id>``, in ascending order; vectors
    that share an id go by their components. Each of ``rounds`` rounds assigns
    all vectors and moves every centroid that has some to the floor of their
    mean; then all are assigned once more. ``k`` centroids and as many sums
    are all that the driver holds.

    Odd rows: a vector that is null or empty, of another length than ``dims``
    or with a null or non-finite component is left out. One without id is
    assigned, but is no first centroid. Repeated rows each count. Components
    beyond ``BOUND`` count as the bound. With fewer than ``k`` vectors there
    are as many centroids as vectors; with none the result is empty. Further
    columns of ``vectors`` are left out.
    """
    whole = settled(whole_vectors(vectors, vec_id, vector, dims, scale))
    first = whole.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        return whole.limit(0).select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), None
    at = np.array([r["x"] for r in first], dtype=np.int64)
    group = grouped(at, n_groups or math.ceil(len(at) / 5))
    c = Centroids(at, group, np.zeros(len(at)))
    state = whole.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), int(group.max()) + 1).alias("lower"))
    for _ in range(rounds):
        state = _passed(state, c, dims)
        c = c.to(_means(state, c.at))
    state = _passed(state, c, dims)
    centre = F.get(F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in c.at]), F.col("cluster"))
    distance = F.aggregate(F.zip_with("x", centre, lambda a, b: (a - b).cast("long") * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    return state.select("vec_id", "x", "cluster", distance.alias("distance")), c


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all embeddings, 3 rounds; sums that leave a long are null."""
    assigned, c = cluster_vectors(common.table(spark, sf_dir, "embeddings"))
    if c is None:
        return assigned.select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    held = settled(assigned.drop("x"))
    total = lambda col: F.sum(col.cast("decimal(20,0)"))
    by_cluster = held.groupBy("cluster").agg(total(F.col("distance")).alias("s")).collect()  # a row for each centroid
    sums = {r["cluster"]: int(r["s"]) for r in by_cluster}
    fits = lambda n: F.lit(n if n < 2**63 else None).cast("long")
    digest = F.array(*[F.sha2(F.lit(",".join(map(str, row))), 256) for row in c.at.tolist()])
    inertia = F.array(*[fits(sums.get(i, 0)) for i in range(len(c.at))])
    pick: Column = F.col("cluster")
    return held.select("vec_id", "cluster", "distance", F.get(inertia, pick).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), F.get(digest, pick).alias("centroid_sha256"))
