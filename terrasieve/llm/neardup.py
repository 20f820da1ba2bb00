"""Near-duplicate groups by bottom-k MinHash sketches.

One hash function gives every shingle a value; a sketch keeps the k smallest
of a document. Inverted lists of retained values yield candidate pairs, the
bottom-k sketch of a pair's union estimates its Jaccard similarity, and the
full sets confirm it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected
from . import common

#: Up to so many ids (some 16 MB) are broadcast to pick their texts; beyond
#: that, a bitmap of their hashes is, of so many bits (16 MB too).
BROADCAST_IDS, BITS = 500_000, 2**27
#: Edges (16 bytes each) that one task finishes by itself; what it finds is
#: dealt out again.
ONE_TASK = 200_000


@lru_cache
def least_shared(k: int, similarity: float, miss: float) -> int:
    """The most c such that a pair at ``similarity`` shares fewer than c of
    its union's k smallest values with a chance under ``miss`` (binomial,
    which is above the true hypergeometric tail)."""
    tail = 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if tail >= miss:
            return c
    return k


def shingle_hashes(df: DataFrame, text: str, width: int, out: str) -> DataFrame:
    """Add the sorted distinct hashes of a text's shingles of ``width`` words.

    Words are lower-cased (A-Z) and parted by ASCII white space. A text of
    fewer words is one shingle; one without words has none.
    """
    df = df.withColumn("_w", common.words(common.lower_ascii(df[text])))
    w = F.col("_w")
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, width)]))
    short = (F.size(w) > 0) & (F.size(w) < width)
    return df.withColumn(out, F.sort_array(F.array_distinct(F.when(short, F.array(F.xxhash64(w))).otherwise(windows)))).drop("_w")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches."""
    return connected(edges, a, b, ONE_TASK, common.settled)


def _similar(shared: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (size_a + size_b - shared)


def _estimate_passes(k: int, percent: int, miss: float) -> Column:
    """Whether the union sketch of a pair (sk_a, n_a, sk_b, n_b) allows a link."""
    both = F.array_intersect("sk_a", "sk_b")
    union = F.slice(F.sort_array(F.array_union("sk_a", "sk_b")), 1, k)
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    shared = F.size(F.array_intersect(union, both))
    return F.when(whole, _similar(F.size(both), F.col("n_a"), F.col("n_b"), percent)).otherwise(shared >= least_shared(k, percent / 100, miss))


def _linked_in_blocks(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between two blocks of (rep, component,
    n, h); pairs that are already of one component are not reported."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
    values = [np.concatenate([np.asarray(h, dtype=np.int64) for h in side["h"]]) for side in (left, right)]
    at = [np.repeat(np.arange(len(side)), side["n"].to_numpy()) for side in (left, right)]
    common_values = np.intersect1d(*values)
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for i in range(0, len(common_values), 8192):
        part = common_values[i : i + 8192]
        grids = []
        for v, rows, side in zip(values, at, (left, right)):
            col = np.searchsorted(part, v)
            hit = (col < len(part)) & (part[np.minimum(col, len(part) - 1)] == v)
            grid = np.zeros((len(side), len(part)), dtype=np.float32)
            grid[rows[hit], col[hit]] = 1
            grids.append(grid)
        shared += grids[0] @ grids[1].T
    shared = shared.astype(np.int64)
    total = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - shared
    ok = (100 * shared >= percent * total) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    la, lb, ca, cb = (s.to_numpy() for s in (left["rep"], right["rep"], left["component"], right["component"]))
    for i, j in zip(*np.nonzero(ok)):
        x, y = root(int(ca[i])), root(int(cb[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(la[i]), int(lb[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _marked(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is among ``ids``, and others by chance (3 %
    of them for 4,000,000 ids). A bitmap of hashes is broadcast, whose size does
    not grow with the ids, so that no row of ``df`` is shuffled."""
    spot = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bucket, at = F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)
    marks = ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.where(F.col(key).isNotNull()).withColumn("_bucket", bucket).join(F.broadcast(marks), "_bucket")
    return met.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*df.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (rep, n, h) are similar enough."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("h").alias(f"h_{x}")) for x in "ab")
    return (
        pairs.select("a", "b").join(left, "a").join(right, "b").where(_similar(F.size(F.array_intersect("h_a", "h_b")), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = 48, miss: float = 1e-9, longest_list: int = 24
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of shingle sets.

    Returns a row for each input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links) and kept (doc_id = component_id).
    Texts without words, null ones among them, are linked with nothing.

    1. Rows with equal sets form a class, known by its smallest doc_id.
    2. Sketches of the classes give inverted lists. A pair at the threshold
       shares at least c sketch values (``least_shared``), so of each sketch
       only the rarest values up to its c-th last are listed: one common
       value is then among those of both (prefix filter).
    3. Lists of up to ``longest_list`` classes give all their pairs, longer
       ones the pairs with the member that has the fewest rare values. The
       union sketch filters pairs and full sets confirm them.
    4. Members of longer lists that step 3 left in different components meet
       block by block in size bands, where links are confirmed on full sets
       and only a spanning forest leaves the task. Nothing is capped.

    A link is missed with a chance under ``miss``; hashes of 64 bits stand for
    shingles. doc_id should be a key: rows that repeat one are treated alike.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = shingle_hashes(source, "text", width, "h")
    base = common.settled(
        hashed.select("doc_id", F.size("h").cast("long").alias("n"), F.slice("h", 1, k).alias("sk"), F.xxhash64("h").alias("f1"), F.hash("h").alias("f2"))
    )
    known = base.where("n > 0 and doc_id is not null")
    classes = known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("sk").alias("sk"), F.count("*").alias("m"))
    reps = common.settled(classes.select("rep", "n", "sk", "f1", "f2", "m"))

    entries = reps.select("rep", F.explode("sk").alias("value"))
    met = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    repeated = entries.join(met, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    c = least_shared(k, percent / 100, miss)
    kept_values = F.least(F.col("n"), F.lit(k))
    whole = F.col("n") * 100 < percent * (k + 1)  # too small for a partner with more than k shingles
    prefix = F.when(whole, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).otherwise(kept_values - c + 1)
    single = kept_values - F.size("values")
    listed = common.settled(
        reps.select("rep", "n").join(repeated, "rep")
        .select("rep", "n", single.alias("single"), F.slice("values", 1, F.greatest(prefix - single, F.lit(0)).cast("int")).alias("values"))
        .select("rep", "n", "single", F.explode("values.value").alias("value"))
    )
    lists = listed.groupBy("value").agg(F.count("*").alias("m"), F.min(F.struct("single", "rep", "n")).alias("hub")).where("m > 1")
    fits = lambda x, y: (F.least(x, y) * 100 >= percent * F.greatest(x, y))
    members = listed.join(lists, "value")
    short = members.where(F.col("m") <= longest_list).select("value", "rep", "n")
    other = short.select("value", F.col("rep").alias("b"), F.col("n").alias("n_b"))
    pairs_short = short.join(other, "value").where((F.col("rep") < F.col("b")) & fits(F.col("n"), F.col("n_b"))).select(F.col("rep").alias("a"), "b")
    long = common.settled(members.where(F.col("m") > longest_list).select("value", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
    pairs_long = long.where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    sketches = {x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sk").alias(f"sk_{x}")) for x in "ab"}
    pairs = pairs_short.union(pairs_long).distinct()
    likely = common.settled(pairs.join(sketches["a"], "a").join(sketches["b"], "b").where(_estimate_passes(k, percent, miss)).select("a", "b"))

    ids = common.settled(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).union(long.select("rep")).distinct())
    # texts stay where they are; sets of texts that a bitmap takes by chance meet no pair
    chosen = source.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else _marked(source, ids, "doc_id")
    sets = common.settled(shingle_hashes(chosen, "text", width, "h").select(F.col("doc_id").alias("rep"), F.size("h").cast("long").alias("n"), "h"))
    links = common.settled(_verified(likely, sets, percent))
    if not long.isEmpty():
        links = common.settled(links.union(_rest_of_long_lists(long, links, sets, percent)))
    found = components(links)
    # texts without words are no class; rows of hot classes stay where they are
    own = reps.join(found, reps["rep"] == found["node"], "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"), "m")
    narrow = base.select("doc_id", "n", "f1", "f2")
    filled = common.join_by_class(narrow.where("n > 0"), own, ["f1", "f2", "n"], "m", base.count(), "left")
    out = filled.unionByName(narrow.where("n = 0").withColumn("component", F.lit(None).cast("long")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest_of_long_lists(long: DataFrame, links: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links between members of long lists that are still in different components.

    Lists that share members make one cluster; its members are dealt into
    bands of sizes a factor of 100 / percent apart, where only equal or
    neighbouring bands can hold a link, and into blocks of about ``block``.
    Members of a cluster's largest component have blocks of their own, so that
    two of those are not compared again.
    """
    clusters = components(long.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    found = components(links)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    nodes = long.select("rep", "n").distinct()
    nodes = nodes.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    )
    nodes = common.settled(nodes.select("rep", "cluster", F.coalesce("component", "rep").alias("component"), band.alias("band")))
    total, tally = nodes.count(), nodes.groupBy("cluster", "component").count()
    largest = tally.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("m"))
    # rows of a hot cluster stay where they are
    nodes = common.join_by_class(nodes, common.settled(largest), ["cluster"], "m", total).withColumn("part", (F.col("component") != F.col("main")).cast("int")).drop("main")
    sizes = nodes.groupBy("cluster", "band", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("m"))
    dealt = common.join_by_class(nodes, common.settled(sizes), ["cluster", "band", "part"], "m", total)
    placed = common.settled(
        dealt.withColumn("block", F.struct("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("nth"))).drop("blocks", "part").join(sets, "rep")
    )
    blocks = placed.groupBy("cluster", "band", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    left, right = (blocks.select("cluster", F.col("band").alias(f"band_{x}"), F.col("block").alias(f"block_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ab")
    meet = left.join(right, "cluster").where(
        ((F.col("band_a") == F.col("band_b")) & (F.col("block_a") <= F.col("block_b")) | (F.col("band_a") + 1 == F.col("band_b")))
        & ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_a") == F.col("lo_b")) & (F.col("lo_b") == F.col("hi_b")))
    )
    meet = common.settled(meet.select("cluster", "band_a", "block_a", "band_b", "block_b"))
    keys = ["cluster", "band_a", "block_a", "band_b", "block_b"]
    sides = [
        meet.join(placed.select("cluster", F.col("band").alias(f"band_{x}"), F.col("block").alias(f"block_{x}"), "rep", "component", "n", "h"), ["cluster", f"band_{x}", f"block_{x}"])
        .select(*[F.to_json(k).alias(f"{x}_{k}") if k.startswith("block") else F.col(k).alias(f"{x}_{k}") for k in keys], *[F.col(v).alias(v) for v in ("rep", "component", "n", "h")])
        .groupBy(*[f"{x}_{k}" for k in keys])
        for x in "ab"
    ]

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _linked_in_blocks(a, b, percent)

    return sides[0].cogroup(sides[1]).applyInPandas(work, "a long, b long")


def op6_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over 2-word shingles at a similarity of 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group kept; columns unchanged. Of rows
    that repeat a doc_id the one of least hash stays; rows without doc_id stay.

    Rows of a repeated doc_id are cut to one for each task before they meet."""
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    repeated = common.settled(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        again = named.join(repeated, "doc_id", "left_semi").select("doc_id", F.xxhash64(*docs.columns).alias("_h"), F.struct(*docs.columns).alias("_row"))
        one = again.groupBy("doc_id").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
        named = named.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))

