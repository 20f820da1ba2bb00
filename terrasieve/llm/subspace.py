"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of a few dimensions. Two vectors
within a distance of each other are, in one block at least, within that
block's share of the squared distance, in proportion to its dimensions. Each
block is range-joined by the leaves of a tree of boxes; what any block finds
is verified on the original vectors.

Crowds of near copies are first put into balls so small that all members are
linked. Balls take part in the join as their centres, with a longer reach; the
triangle inequality settles most pairs of balls as a whole, the others are
compared member by member inside tasks that send on sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators.components import connected
from . import common
from .ann import _valid

#: Rows of a leaf that one task compares with up to ``_GUESTS`` visitors.
_HOME, _GUESTS = 4096, 32_768
#: Sign patterns that look for crowds, the rows that make one worth a ball,
#: and the members that a ball keeps at least.
_PATTERNS, _CROWD, _LEAST = 4, 16, 8
#: Numbers (8 bytes each) of the sample that places the boxes.
_SAMPLE = 2**20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that their squares neither overflow
    nor vanish; all else about them stays to the last bit."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0))[1][:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def rotation(dims: int, seed: int = 12) -> np.ndarray:
    """A random rotation; many dimensions are only dealt out anew."""
    rng = np.random.default_rng(seed)
    if dims > 1024:
        out = np.zeros((dims, dims))
        out[rng.permutation(dims), np.arange(dims)] = 1
        return out
    return np.linalg.qr(rng.normal(size=(dims, dims)))[0]


@dataclass
class Boxes:
    """A complete tree of cuts at medians; its leaves are boxes."""

    dim: np.ndarray
    cut: np.ndarray
    levels: int

    @classmethod
    def fit(cls, points: np.ndarray, levels: int) -> Boxes:
        dim, cut = np.zeros(2**levels, dtype=int), np.zeros(2**levels)
        parts = {1: points}
        for node in range(1, 2**levels):
            p = parts.pop(node)
            if len(p):
                dim[node] = p.std(axis=0).argmax()
                cut[node] = np.median(p[:, dim[node]])
            right = p[:, dim[node]] >= cut[node]
            parts[2 * node], parts[2 * node + 1] = p[~right], p[right]
        return cls(dim, cut, levels)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=int)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] >= self.cut[node])
        return node - 2**self.levels

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that a ball around each point meets."""
        row, node = np.arange(len(points)), np.ones(len(points), dtype=int)
        off, far2 = np.zeros(points.shape), np.zeros(len(points))
        most = reach**2 * (1 + 1e-9) + 1e-18
        for _ in range(self.levels):
            at, d = np.arange(len(row)), self.dim[node]
            gap = points[row, d] - self.cut[node]
            other2 = far2 - off[at, d] ** 2 + gap**2
            cross = np.flatnonzero(other2 <= most[row])
            crossed = off[cross].copy()
            crossed[np.arange(len(cross)), d[cross]] = np.abs(gap[cross])
            right = (gap >= 0).astype(int)
            node = np.concatenate([2 * node + right, 2 * node[cross] + 1 - right[cross]])
            row, off, far2 = np.concatenate([row, row[cross]]), np.concatenate([off, crossed]), np.concatenate([far2, other2[cross]])
        return row, node - 2**self.levels


@dataclass
class Blocks:
    """Dimensions of each block, its boxes, and its share of a squared distance."""

    ends: list[tuple[int, int]]
    boxes: list[Boxes]
    radius: float

    @classmethod
    def fit(cls, sample: np.ndarray, n: int, radius: float, home: int = _HOME) -> Blocks:
        """Blocks widen with log n, so that chance candidates do not pile up;
        boxes get about ``home`` rows, and 16 rows of the sample at least."""
        dims = sample.shape[1]
        count = max(1, round(dims / max(4.0, 0.7 * math.log2(max(n, 2)))))
        cuts = [round(i * dims / count) for i in range(count + 1)]
        levels = max(0, min(math.ceil(math.log2(max(1, n / home))), int(math.log2(max(1, len(sample) / 16)))))
        ends = list(zip(cuts, cuts[1:]))
        return cls(ends, [Boxes.fit(sample[:, a:b], levels) for a, b in ends], radius)

    def reach(self, block: int, extra: np.ndarray | float) -> np.ndarray:
        """The distance that a block allows to a pair whose balls add ``extra``;
        coordinates travel in single precision."""
        a, b = self.ends[block]
        return (self.radius + extra) * math.sqrt((b - a) / self.ends[-1][1]) + 4e-6


def _block_join(units: DataFrame, blocks: Blocks, widest: float, home: int = _HOME, guests: int = _GUESTS) -> DataFrame:
    """Pairs (a, b) of units, each (unit, ball, rho, y), that one block at
    least allows. A pair meets once in a block: in the home leaf of a point
    when the other one, of a later or the same leaf, visits it; balls also
    visit all leaves of points."""

    def rows(batches: Iterator[pd.DataFrame], visit: bool) -> Iterator[pd.DataFrame]:
        for batch in (b for b in batches if len(b)):
            y, ball, rho = _matrix(batch["y"]), batch["ball"].to_numpy(), batch["rho"].to_numpy()
            for i, ((a, b), boxes) in enumerate(zip(blocks.ends, blocks.boxes)):
                z = np.ascontiguousarray(y[:, a:b], dtype=np.float32)
                own, packed = boxes.leaf(z.astype(np.float64)), np.array([r.tobytes() for r in z], dtype=object)
                for kind in (False, True):
                    if visit:
                        mine = np.flatnonzero(ball) if kind else np.arange(len(y))
                        at, leaf = boxes.within(z[mine].astype(np.float64), np.broadcast_to(blocks.reach(i, rho[mine] + (widest if kind else 0)), len(mine)))
                        same = ball[mine[at]] == kind
                        keep = ~same | (leaf <= own[mine[at]])
                        at, leaf = mine[at[keep]], leaf[keep]
                    else:
                        at = np.flatnonzero(ball == kind)
                        leaf = own[at]
                    if len(at):
                        units_ = batch["unit"].to_numpy()[at]
                        yield pd.DataFrame({"unit": units_, "block": np.int32(i), "kind": kind, "leaf": leaf.astype(np.int32), "at_home": (ball[at] == kind) & (own[at] == leaf), "rho": rho[at], "z": packed[at]})

    schema = "unit long, block int, kind boolean, leaf int, at_home boolean, rho double, z binary"
    given, key = units.select("unit", "ball", "rho", "y"), ["block", "kind", "leaf"]
    homes = settled(given.mapInPandas(lambda it: rows(it, False), schema))
    visits = settled(given.mapInPandas(lambda it: rows(it, True), schema))
    parts = lambda d, most, name: d.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # a row for each leaf that has rows, some thousands at most
    cut = F.broadcast(settled(parts(homes, home, "n_home").join(parts(visits, guests, "n_guest"), key)))
    deal = lambda name: F.pmod(F.xxhash64("unit"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = homes.join(cut, key).withColumn("h", deal("n_home")).withColumn("g", each("n_guest")).drop("n_home", "n_guest")
    come = visits.join(cut, key).withColumn("g", deal("n_guest")).withColumn("h", each("n_home")).drop("n_home", "n_guest")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.array([], dtype=np.int64),) * 2]
        if len(left) and len(right):
            block = int(left["block"].iloc[0])
            read = lambda side: np.frombuffer(b"".join(side["z"]), dtype=np.float32).reshape(len(side), -1).astype(np.float64)
            x, ids, rho = read(left), left["unit"].to_numpy(), left["rho"].to_numpy()
            xx = (x * x).sum(axis=1)
            for i in range(0, len(right), 1024):
                part = right.iloc[i : i + 1024]
                v = read(part)
                d2 = (v * v).sum(axis=1)[:, None] - 2 * v @ x.T + xx[None]
                most = blocks.reach(block, part["rho"].to_numpy()[:, None] + rho[None] if rho.any() or part["rho"].any() else 0.0) ** 2
                q, h = np.nonzero(d2 <= most)
                others = part["unit"].to_numpy()[q]
                # of one leaf, the smaller id is at home
                keep = ~part["at_home"].to_numpy()[q] | (ids[h] < others)
                found.append((np.minimum(ids[h], others)[keep], np.maximum(ids[h], others)[keep]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b})

    key = [*key, "h", "g"]
    return own.groupBy(*key).cogroup(come.groupBy(*key)).applyInPandas(work, "a long, b long").distinct()


def _balls(points: DataFrame, dims: int, radius: float) -> tuple[DataFrame, DataFrame] | None:
    """(cid, unit) of the points in balls, and (unit, rho, size, weight, y) of
    the balls: unit is the smallest cid, rho the largest distance to the centre
    y. Members are within ``radius`` / 2 of it, hence all linked. None without
    a crowd.

    A point goes to the fullest of its sign patterns, if that is a crowd; the
    centre is the mean of those that went there."""
    signed = settled(points.select("cid", F.posexplode("signs").alias("nth", "sign")))
    crowds = settled(signed.groupBy("nth", "sign").agg(F.count("*").alias("m")).where(F.col("m") >= _CROWD))
    if crowds.isEmpty():
        return None
    most = max(16, min(4096, 2**22 // dims))
    total = signed.count()
    told = common.join_by_class(signed, crowds.withColumn("held", F.col("m")), ["nth", "sign"], "m", total, most=most)
    own = told.groupBy("cid").agg(F.max(F.struct("held", "nth", "sign")).alias("c")).select("cid", "c.nth", "c.sign")
    went = settled(points.select("cid", "w", "y").join(own, "cid"))
    key = ["nth", "sign"]

    def part_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b for b in batches if len(b)):
            which, at = np.unique(batch[key].to_numpy(), axis=0, return_inverse=True)
            sums = np.zeros((len(which), dims))
            np.add.at(sums, at.ravel(), _matrix(batch["y"]))
            yield pd.DataFrame({"nth": which[:, 0].astype(np.int32), "sign": which[:, 1], "m": np.bincount(at.ravel()).astype(np.int64), "y": list(sums)})

    def whole_sums(part: pd.DataFrame) -> pd.DataFrame:
        total_ = _matrix(part["y"]).sum(axis=0)
        length = math.sqrt((total_**2).sum())
        centre = total_ / length if length > 0 else total_
        return pd.DataFrame({"nth": part["nth"].iloc[:1], "sign": part["sign"].iloc[:1], "m": [int(part["m"].sum())], "centre": [centre]})

    sums = went.select(*key, "y").mapInPandas(part_sums, "nth int, sign long, m long, y array<double>")
    centres = settled(sums.groupBy(*key).applyInPandas(whole_sums, "nth int, sign long, m long, centre array<double>"))

    @F.pandas_udf("double")
    def distance(y: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((_matrix(y) - _matrix(c)) ** 2).sum(axis=1)))

    near = common.join_by_class(went, centres, key, "m", total, most=most).withColumn("d", distance("y", "centre")).where(F.col("d") <= radius / 2 * (1 - 1e-9))
    near = settled(near.select("cid", "w", *key, "d"))
    kept = near.groupBy(*key).agg(F.min("cid").alias("unit"), F.max("d").alias("rho"), F.count("*").alias("size"), F.sum("w").alias("weight")).where(F.col("size") >= _LEAST)
    balls = settled(kept.join(centres.select(*key, F.col("centre").alias("y")), key))
    if balls.isEmpty():
        return None
    members = common.join_by_class(near.select("cid", *key), balls.withColumn("m", F.col("size")).select(*key, "unit", "m"), key, "m", total, most=most)
    return settled(members.select("cid", "unit")), balls.select("unit", "rho", "size", "weight", "y")


def _mixed(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(cid, partner, links) of pairs (host, guest, n_host) that no bound
    settles: the weight of the links of each member, and a row of host and
    guest where there is a link. ``members`` has (unit, cid, w, x)."""
    sizes = pairs.groupBy("host").agg(F.max("n_host").alias("n_host"), F.sum("n_guest").alias("guests"))
    cut = settled(sizes.select("host", F.ceil(F.col("n_host") / _HOME).cast("int").alias("n_h"), F.ceil(F.col("guests") / _GUESTS).cast("int").alias("n_g"), F.col("n_host").alias("m")))
    deal = lambda name: F.pmod(F.xxhash64("cid"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = common.join_by_class(members.withColumnRenamed("unit", "host"), cut, ["host"], "m", max(1, members.count()))
    left = left.withColumn("h", deal("n_h")).withColumn("g", each("n_g")).drop("n_h", "n_g")
    guests = members.select(F.col("unit").alias("guest"), *[F.col(c).alias(c) for c in ("cid", "w", "x")])  # columns of its own
    right = pairs.select("host", "guest").join(guests, "guest").join(cut.drop("m"), "host")
    right = right.withColumn("g", deal("n_g")).withColumn("h", each("n_h")).drop("n_h", "n_g")

    def work(own: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"cid": [], "partner": [], "links": []})]
        if len(own) and len(come):
            x, w, linked = _matrix(own["x"]), own["w"].to_numpy(), np.zeros(len(own), dtype=np.int64)
            u = _unit(x)
            for i in range(0, len(come), 1024):
                part = come.iloc[i : i + 1024]
                v = _matrix(part["x"])
                near = _unit(v) @ u.T
                ok = near >= least
                for r, c in zip(*np.nonzero(np.abs(near - least) < 1e-9)):  # the sum that pairs elsewhere get
                    ok[r, c] = cosines(v[r : r + 1], x[c : c + 1])[0] >= least
                linked += ok.T.astype(np.int64) @ part["w"].to_numpy()
                out.append(pd.DataFrame({"cid": part["cid"], "partner": -1, "links": ok.astype(np.int64) @ w}))
                hit = part["guest"].to_numpy()[ok.any(axis=1)]
                out.append(pd.DataFrame({"cid": own["host"].iloc[0], "partner": np.unique(hit), "links": 0}))
            out.append(pd.DataFrame({"cid": own["cid"], "partner": -1, "links": linked}))
        all_ = pd.concat(out).astype("int64")
        told = all_["partner"] >= 0
        return pd.concat([all_[~told & (all_["links"] > 0)], all_[told].drop_duplicates()]).assign(edge=lambda d: d["links"] == 0)

    found = left.groupBy("host", "h", "g").cogroup(right.groupBy("host", "h", "g")).applyInPandas(work, "cid long, partner long, links long, edge boolean")
    return settled(found)


def _linked(classes: DataFrame, dims: int, least: float, seed: int) -> DataFrame:
    """(cid, n_links, component) of different vectors (cid, w, x) of one
    length; links to other vectors, each counted with its weight."""
    n, radius = classes.count(), math.sqrt(2 - 2 * least)
    turn = rotation(dims, seed)
    bits = min(60, math.ceil(math.log2(n + 1)) + 2)
    planes = np.random.default_rng(seed + 1).normal(size=(dims, _PATTERNS * bits))
    powers = 2 ** np.arange(bits, dtype=np.int64)

    @F.pandas_udf("y array<double>, signs array<long>")
    def turned(column: pd.Series) -> pd.DataFrame:
        u = _unit(_matrix(column).reshape(-1, dims))
        signs = (u @ planes > 0).reshape(len(u), _PATTERNS, bits).astype(np.int64) @ powers
        return pd.DataFrame({"y": list(u @ turn), "signs": list(signs)})

    points = settled(classes.withColumn("t", turned("x")).select("cid", "w", "x", "t.y", "t.signs"))
    singles = points.select(F.col("cid").alias("unit"), F.lit(False).alias("ball"), F.lit(0.0).alias("rho"), F.lit(1).cast("long").alias("size"), F.col("w").alias("weight"), "y")
    found = _balls(points, dims, radius)
    if found:
        member, balls = found
        singles = singles.join(member.select(F.col("cid").alias("unit")), "unit", "left_anti")
        singles = singles.unionByName(balls.withColumn("ball", F.lit(True)))
    units = settled(singles)
    widest = units.agg(F.max("rho")).first()[0]
    chosen = units.select("y").orderBy(F.xxhash64("unit"), "unit").limit(max(16, _SAMPLE // dims)).collect()
    blocks = Blocks.fit(np.array([r["y"] for r in chosen]), n, radius)
    pairs = settled(_block_join(units, blocks, widest))

    # originals of points, centres of balls
    side = units.select("unit", "ball", "rho", "size", "weight", "y").join(points.select(F.col("cid").alias("unit"), "x"), "unit", "left")
    side = settled(side.select("unit", "ball", "rho", "size", "weight", F.when(F.col("ball"), F.col("y")).otherwise(F.col("x")).alias("v"), "y"))
    of = lambda s: side.select(F.col("unit").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ball", "rho", "size", "weight", "v", "y")])

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(cosines(_matrix(a), _matrix(b)))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((_matrix(a) - _matrix(b)) ** 2).sum(axis=1)))

    met = pairs.join(of("a"), "a").join(of("b"), "b")
    narrow = ["a", "b", "ball_a", "size_a", "size_b", "weight_a", "weight_b"]
    plain = met.where(~F.col("ball_a") & ~F.col("ball_b")).withColumn("c", cosine("v_a", "v_b")).where(F.col("c") >= least).select(*narrow, F.lit(True).alias("whole"))
    if found:
        reach = F.col("rho_a") + F.col("rho_b")
        round_ = met.where(F.col("ball_a") | F.col("ball_b")).withColumn("d", distance("y_a", "y_b")).where(F.col("d") - reach <= radius * (1 + 1e-9))
        plain = plain.unionByName(round_.select(*narrow, (F.col("d") + reach <= radius * (1 - 1e-9)).alias("whole")))
    judged = settled(plain)
    whole = judged.where("whole")
    edges = whole.select("a", "b")
    add = whole.select(F.col("a").alias("unit"), F.col("weight_b").alias("add")).unionByName(whole.select(F.col("b").alias("unit"), F.col("weight_a").alias("add")))
    add = add.groupBy("unit").agg(F.sum("add").alias("add"))
    unit = points.select("cid", F.col("cid").alias("unit"))
    extra = None
    if found:
        unit = unit.drop("unit").join(member, "cid", "left").select("cid", F.coalesce("unit", "cid").alias("unit"))
        open_ = settled(judged.where("not whole").select(*[F.when(F.col("ball_a"), F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("a", "b", "host"), ("b", "a", "guest"), ("size_a", "size_b", "n_host"), ("size_b", "size_a", "n_guest"))]))
        if not open_.isEmpty():
            asked = settled(open_.select(F.explode(F.array("host", "guest")).alias("unit")).distinct())
            told = _mixed(open_, settled(unit.join(asked, "unit", "left_semi").join(points.select("cid", "w", "x"), "cid")), least)
            edges = edges.unionByName(told.where("edge").select(F.col("cid").alias("a"), F.col("partner").alias("b")).distinct())
            extra = told.where("not edge").groupBy("cid").agg(F.sum("links").alias("extra"))
    component = connected(edges)
    filled = units.select("unit", "weight", "size").join(add, "unit", "left").join(component, F.col("unit") == F.col("node"), "left")
    filled = settled(filled.select("unit", "size", (F.col("weight") + F.coalesce("add", F.lit(0))).alias("n_links"), F.coalesce("component", "unit").alias("component")))
    out = common.join_by_class(unit.join(points.select("cid", "w"), "cid"), filled, ["unit"], "size", n)
    out = out.select("cid", (F.col("n_links") - F.col("w")).alias("n_links"), "component")
    if extra is None:
        return out
    return out.join(extra, "cid", "left").select("cid", (F.col("n_links") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component")


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 12) -> DataFrame:
    """A row for each row of ``vectors``: vec_id, n_links (other rows at a
    cosine of ``least`` or more), component_id (the smallest vec_id reachable)
    and kept (vec_id = component_id). 0 < ``least`` < 1.

    Equal vectors form a class of one weight. All candidates are verified on
    the original vectors in double precision, or follow from the triangle
    inequality; nothing is capped and no link is missed.

    Odd rows: vectors that are null, empty, zero or with null or non-finite
    components link with nothing, nor do rows without id, which are kept.
    Vectors of different lengths have no cosine; each length that occurs twice
    is joined apart. Repeated rows are linked with each other and counted. An
    empty table gives no rows. Further columns are left out.
    """
    data = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    fine = F.col("vec_id").isNotNull() & _valid(F.col("x"))
    marks = [F.xxhash64("x").alias("f1"), F.xxhash64(F.lit(seed), "x").alias("f2")]
    base = settled(data.select("vec_id", F.when(fine, F.col("x")).alias("x")).select("vec_id", "x", *marks))
    valid = base.where("x is not null")
    classes = valid.groupBy("f1", "f2").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"), F.first("x").alias("x"))
    classes = settled(classes.withColumn("cid", F.monotonically_increasing_id()))  # ids may repeat
    lengths = classes.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).where("n > 1").collect()
    narrow = base.select("vec_id", "f1", "f2", F.col("x").isNotNull().alias("valid"))
    found = classes.select("cid", F.lit(0).cast("long").alias("n_links"), F.col("cid").alias("component")).limit(0)
    for r in sorted(lengths, key=lambda r: r["dims"]):  # one length, as a rule
        found = found.unionByName(_linked(classes.where(F.size("x") == r["dims"]).select("cid", "w", "x"), r["dims"], least, seed))
    told = classes.drop("x").join(found, "cid", "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0)) + F.col("w") - 1, "component": F.coalesce("component", "cid")})
    told = settled(told)
    least_id = settled(told.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("m")))
    told = common.join_by_class(told, least_id, ["component"], "m", max(1, told.count())).select("f1", "f2", F.col("w").alias("m"), "n_links", "component_id")
    linked = common.join_by_class(narrow.where("valid"), told, ["f1", "f2"], "m", max(1, base.count())).select("vec_id", "n_links", "component_id")
    alone = narrow.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op12_subspace_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.95 or more."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
