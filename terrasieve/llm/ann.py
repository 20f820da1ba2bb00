"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass
class MultiIndex:
    """Centroids of each half of the unit vectors, the row count of each pair
    of centroids, and the share of all rows that a search visits."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    share: float

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.argmin(d, axis=1) for d in half_distances(unit, self.halves))

    def visits(self, unit: np.ndarray, least: int = 64) -> list[list[tuple[int, int]]]:
        """For each query the centroid pairs to visit."""
        wanted = max(least, self.share * self.counts.sum())
        d1, d2 = half_distances(unit, self.halves)
        return [[p for p in traverse(a, b, self.counts, wanted)] for a, b in zip(d1, d2)]


def half_distances(unit: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each vector's halves to that half's centroids."""
    cut = halves[0].shape[1]
    out = []
    for x, c in ((unit[:, :cut], halves[0]), (unit[:, cut:], halves[1])):
        out.append(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0))
    return out[0], out[1]


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: float) -> Iterator[tuple[int, int]]:
    """Centroid pairs by growing summed distance until they hold ``wanted``
    rows. A heap holds the frontier of the two sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, have = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        a, b = int(o1[i]), int(o2[j])
        if counts[a, b]:
            have += int(counts[a, b])
            yield a, b
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(o1) and y < len(o2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def centroids_for(n_rows: int) -> int:
    """Centroids a half: they grow with the table, so that the pairs' lists
    do not; 1,024 at most, as the counts of all pairs (8 MB) are held."""
    return int(min(1024, max(4, math.sqrt(n_rows) / 8)))


def fit_index(unit: np.ndarray, n_rows: int, seed: int = 4) -> MultiIndex:
    """Centroids of both halves from a bounded sample of unit vectors. It has
    no counts yet and visits everything."""
    k, cut = centroids_for(n_rows), unit.shape[1] // 2
    halves = (_kmeans(unit[:, :cut], k, seed), _kmeans(unit[:, cut:], k, seed + 1))
    return MultiIndex(halves, np.zeros((len(halves[0]), len(halves[1])), dtype=np.int64), 1.0)


def share_needed(index: MultiIndex, asked: np.ndarray, true: list[list[tuple[int, int]]], recall: float) -> float:
    """The smallest share of all rows that gives ``recall`` of the ``true``
    neighbours, known by their centroid pairs, of the unit vectors ``asked``."""
    total, needed = index.counts.sum(), []
    d1, d2 = half_distances(asked, index.halves)
    for a, b, pairs in zip(d1, d2, true):
        have, open_, reached = 0, set(pairs), {}
        for pair in traverse(a, b, index.counts, np.inf):
            have += int(index.counts[pair])
            if pair in open_:
                reached[pair] = have
                open_.discard(pair)
                if not open_:
                    break
        needed += [reached[p] / total for p in pairs]
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def _valid(vector: Column) -> Column:
    """Not null or empty, all components finite, and not the zero vector."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _search_block(rows: pd.DataFrame, queries: pd.DataFrame, neighbours: int) -> pd.DataFrame:
    """The nearest visited entries of one block for one block of queries.

    ``rows`` has vec_id, second (code of the second half) and vector;
    ``queries`` has query_id, vector and seconds (the codes to visit).
    Matrix products make a shortlist, with a margin above their error; its
    scores are summed row by row in double precision, so that equal vectors
    score equal wherever they stand."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(rows) and len(queries):
        ids, m = rows["vec_id"].to_numpy(), _matrix(rows["vector"])
        norms, second = _norms(m), rows["second"].to_numpy()
        unit = m / norms[:, None]
        cells = {int(c): np.flatnonzero(second == c) for c in np.unique(second)}
        q_ids, qm = queries["query_id"].to_numpy(), _matrix(queries["vector"])
        q_norms = _norms(qm)
        q_unit = qm / q_norms[:, None]
        wants = [set(map(int, s)) for s in queries["seconds"]]
        for start in range(0, len(q_ids), 256):
            part = np.arange(start, min(start + 256, len(q_ids)))
            score = np.full((len(part), len(ids)), -np.inf)
            for c, inside in cells.items():
                asking = np.flatnonzero([c in wants[q] for q in part])
                if len(asking):
                    score[np.ix_(asking, inside)] = q_unit[part[asking]] @ unit[inside].T
            score[q_ids[part][:, None] == ids[None, :]] = -np.inf
            n = min(neighbours, len(ids))
            floor = -np.partition(-score, n - 1, axis=1)[:, n - 1]
            for i, q in enumerate(part):
                near = np.flatnonzero((score[i] >= floor[i] - 1e-9) & np.isfinite(score[i]))
                exact = (m[near] * qm[q]).sum(axis=1) / (norms[near] * q_norms[q])
                first = np.lexsort((ids[near], -exact))[:neighbours]
                out.append((np.full(len(first), q_ids[q]), ids[near][first], exact[first]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.array([])] * 3
    return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.float64)})


def _true_neighbours(coded: DataFrame, ids: np.ndarray, unit: np.ndarray, neighbours: int) -> list[list[tuple[int, int]]]:
    """Centroid pairs of the nearest rows of a few unit vectors among all
    rows: each task keeps its best for each of them, which meet in one row
    for each."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in (b for b in batches if len(b)):
            m = _matrix(batch["vector"])
            score = unit @ (m / _norms(m)[:, None]).T
            score[ids[:, None] == batch["vec_id"].to_numpy()[None, :]] = -np.inf
            n = min(neighbours, len(batch))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(score, at, axis=1).ravel()
            rows = pd.DataFrame({"asked": np.repeat(np.arange(len(ids)), n), "score": near, "first": batch["first"].to_numpy()[at.ravel()], "second": batch["second"].to_numpy()[at.ravel()]})
            held = [pd.concat([*held, rows[np.isfinite(near)]]).sort_values("score", ascending=False, kind="stable").groupby("asked").head(neighbours)]
        yield from held

    found = coded.select("vec_id", "vector", "first", "second").mapInPandas(best, "asked int, score double, first int, second int")
    place = Window.partitionBy("asked").orderBy(F.desc("score"), "first", "second")
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    for r in found.withColumn("_nth", F.row_number().over(place)).where(F.col("_nth") <= neighbours).collect():
        out[r["asked"]].append((r["first"], r["second"]))
    return out


def search(
    vectors: DataFrame,
    queries: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    neighbours: int = 5,
    recall: float = 0.97,
    sample: int = 8192,
    measured: int = 256,
    block: int = 16_384,
    query_block: int = 65_536,
) -> DataFrame:
    """The ``neighbours`` nearest rows by cosine of the rows that ``queries``
    picks, without the query's own id: query_id, rank, vec_id and score.

    Unit vectors are cut in halves, each quantised to its nearest centroid
    (fitted on ``sample`` rows of least hash, or 16 for each centroid where
    those are more; every row is indexed). The true neighbours among all rows
    of ``measured`` rows of the sample tell which share of the rows must be
    visited for ``recall``. A query visits centroid pairs by summed distance
    from a heap until they hold that share, and reranks what they list by
    exact cosine. Work is dealt by first-half centroid, blocks of its rows and
    larger blocks of the queries that visit it, so a crowded list is split,
    and a list is sent out once for each ``query_block`` queries.

    Vectors null, zero, empty, with null or non-finite components, or of
    another length than most have no part, nor have rows without id. Ties go
    to the smaller id. Rows that repeat an id are all candidates, and one
    query. A table without valid vectors gives no rows.
    """
    spark = vectors.sparkSession
    data = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked"))
    data = data.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    lengths = data.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, n_rows = lengths["dims"], lengths["count"]
    data = data.where(F.size("vector") == dims)
    chosen = data.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 16 * centroids_for(n_rows))).collect()
    known = np.array([r["vector"] for r in chosen], dtype=np.float64)
    known /= _norms(known)[:, None]
    index = fit_index(known, n_rows)

    @F.pandas_udf("first int, second int")
    def encode(column: pd.Series) -> pd.DataFrame:
        m = _matrix(column).reshape(-1, dims)
        a, b = index.codes(m / _norms(m)[:, None])
        return pd.DataFrame({"first": a, "second": b})

    coded = common.settled(data.withColumn("code", encode("vector")).select("vec_id", "vector", "asked", "code.first", "code.second"))
    counted = coded.groupBy("first", "second").count().toPandas()  # at most 1,024 x 1,024 pairs
    index.counts[counted["first"], counted["second"]] = counted["count"]
    ids, at = np.unique([r["vec_id"] for r in chosen[: 4 * measured]], return_index=True)
    ids, unit = ids[:measured], known[at[:measured]]
    index.share = share_needed(index, unit, _true_neighbours(coded, ids, unit, neighbours), recall)
    row_blocks = np.maximum(1, np.ceil(index.counts.sum(axis=1) / block)).astype(int).tolist()
    asking = coded.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))

    @F.pandas_udf("array<struct<first:int,seconds:array<int>>>")
    def plan(column: pd.Series) -> pd.Series:
        m = _matrix(column).reshape(-1, dims)
        out = []
        for pairs in index.visits(m / _norms(m)[:, None]):
            by_first: dict[int, list[int]] = {}
            for a, b in pairs:
                by_first.setdefault(a, []).append(b)
            out.append([{"first": a, "seconds": b} for a, b in sorted(by_first.items())])
        return pd.Series(out)

    wanted = asking.select(F.col("vec_id").alias("query_id"), "vector", F.explode(plan("vector")).alias("v"))
    wanted = common.settled(wanted.select("query_id", "vector", F.col("v.first").alias("q_first"), F.col("v.seconds").alias("seconds")))
    visitors = np.zeros(len(row_blocks), dtype=np.int64)
    for r in wanted.groupBy("q_first").count().collect():  # a row for each centroid of the first half
        visitors[r["q_first"]] = r["count"]
    of = lambda numbers, c: F.get(F.array(*[F.lit(int(x)) for x in numbers]), c)
    query_blocks = np.ceil(visitors / query_block).astype(int)  # none where no query comes
    wanted = wanted.withColumn("q_block", F.pmod(F.xxhash64("query_id"), of(query_blocks, F.col("q_first"))).cast("int")).withColumn(
        "q_row_block", F.explode(F.sequence(F.lit(0), of(row_blocks, F.col("q_first")) - 1))
    )
    entries = coded.where(of(query_blocks, F.col("first")) > 0).select(
        "vec_id",
        "vector",
        "first",
        "second",
        F.pmod(F.xxhash64("vec_id", "vector"), of(row_blocks, F.col("first"))).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), of(query_blocks, F.col("first")) - 1)).alias("e_block"),
    )

    def work(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _search_block(rows, asked, neighbours)

    found = (
        entries.groupBy("first", "row_block", "e_block")
        .cogroup(wanted.groupBy("q_first", "q_row_block", "q_block"))
        .applyInPandas(work, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
