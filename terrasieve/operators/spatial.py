"""Spatial operators on points in degrees, by grid buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import settled
from .components import connected
from .guards import ContractError

KM_PER_DEGREE = math.pi * S.EARTH_RADIUS_KM / 180


def block_id(lon: Column, lat: Column, degrees: float) -> Column:
    """Grid block such as ``2deg_27_61``."""
    ix, iy = F.floor((lon + 180) / degrees), F.floor((lat + 90) / degrees)
    return F.concat_ws("_", F.lit(f"{degrees:g}deg"), ix.cast("string"), iy.cast("string"))


def _cells(df: DataFrame, km: float, lat: str, lon: str, around: bool) -> DataFrame:
    """Rows with their grid cell, or all nine cells around. A cell is ``km``
    high, and as wide at its row's greater latitude, so that points within
    ``km`` are in neighbouring cells. Longitudes turn at 180 degrees."""
    step = km / KM_PER_DEGREE * 1.0001
    row = F.floor((F.col(lat) + 90) / step).cast("long")
    out = df.withColumn("_row", F.explode(F.array(*[row + d for d in ((-1, 0, 1) if around else (0,))])))
    edge = F.least(F.greatest(F.abs((F.col("_row") + 2) * step - 90), F.abs((F.col("_row") - 1) * step - 90)), F.lit(89.9))
    n = F.greatest(F.floor(360 * F.cos(F.radians(edge)) / step), F.lit(3))
    col = F.floor((F.col(lon) + 180) / (360 / n)).cast("long")
    cols = F.array_distinct(F.array(*[F.pmod(col + d, n) for d in ((-1, 0, 1) if around else (0,))]))
    return out.withColumn("_col", F.explode(cols))


def within(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", right_prefix: str = "r_") -> DataFrame:
    """Pairs of points at most ``km`` apart (inclusive), with ``km_apart``:
    an equi-join on grid cells, then the distance. Right columns get the
    prefix."""
    l = _cells(left, max(km, 1e-6), lat, lon, around=False)
    r = _cells(right, max(km, 1e-6), lat, lon, around=True)
    r = r.select(*[F.col(c).alias(f"{right_prefix}{c}") for c in right.columns], "_row", "_col")
    d = S.haversine_km(F.col(lat), F.col(lon), F.col(f"{right_prefix}{lat}"), F.col(f"{right_prefix}{lon}"))
    return l.join(r, ["_row", "_col"]).drop("_row", "_col").withColumn("km_apart", d).where(F.col("km_apart") <= km)


#: Cells of the sphere are halved until no one has more different places, or
#: so often (some 6 m).
CROWD, DEEPEST = 64, 20
#: Coarsest cells that are paired without a parent.
TOP = 3


def _cube(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def _code(xyz: Sequence[Column]) -> Column:
    """The finest cell: bits of the three coordinates in turn, so that a cell
    of a coarser level is a prefix of its parts."""
    n = 2**DEEPEST
    whole = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((c + 1) / 2 * n))).cast("long") for c in xyz]
    out = F.lit(0).cast("long")
    for bit in range(DEEPEST):
        for axis, w in enumerate(whole):
            out = out + F.shiftleft(F.shiftright(w, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + axis)
    return out


def _at(level: int, code: str = "code") -> Column:
    return F.shiftright(code, 3 * (DEEPEST - level))


_BOX = [f"{side}{c}" for c in "xyz" for side in ("lo_", "hi_")]


def _nodes(places: DataFrame, level: int, group: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """Cells of a level by group with the box of their places."""
    box = [f(c).alias(f"{side}{c}") for c in "xyz" for side, f in (("lo_", F.min), ("hi_", F.max))]
    return places.groupBy(_at(level).alias("cell"), *group).agg(*box, *more)


def _bounds(left: str, right: str) -> tuple[Column, Column]:
    """Squares of the least and the largest distance between two boxes."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        lo, hi, rlo, rhi = (F.col(f"{p}{side}{c}") for p in (left, right) for side in ("lo_", "hi_"))
        least = least + F.pow(F.greatest(rlo - hi, lo - rhi, F.lit(0.0)), 2)
        most = most + F.pow(F.greatest(rhi - lo, hi - rlo), 2)
    return least, most


def nearest(
    left: DataFrame, right: DataFrame, key: str, right_key: str, lat: str = "lat", lon: str = "lon", fold: str | None = None, label: str | None = None, alike: bool | None = None,
    each_fold: bool = False, within_km: float | None = None, each_label: bool = False, by_place: bool = False,
) -> DataFrame:
    """For each left row the nearest right one: key, r_<right_key>, km_apart
    (ties to the smaller right key). With ``fold``, the nearest right row of
    another fold, and the left row's fold first; with ``each_fold`` that of
    every other fold, as r_<fold>. With ``label``, one of the same label
    (``alike``) or of another; with ``each_label`` that of every label, as
    r_<label>. With ``within_km`` only those so near. ``by_place`` leaves the
    left keys out: one row for each place (lat, lon), and fold or label that
    the search depends on.

    Cells of the sphere form a tree, whose nodes know their box and which
    folds and labels they hold. All levels are descended together: a left cell
    keeps the right cells that may hold the nearest row of a place in it,
    judged by the boxes, and only those that hold a fold and label it may
    meet. So rows of one fold never meet each other, and a crowd costs its
    cells. Rows without a place, fold or label that is asked for have no
    partner and are none; rows of one place count once in the search, whatever
    their folds with ``each_fold``, as the nearest row of a fold is the same
    for all of them.

    In the end cells meet as lists of their places, so that a place and a cell
    make one row, not one for each place of the cell."""
    own = [F.col(fold) if fold else F.lit(0), F.col(label) if label else F.lit(0)]
    wanted, label = label, None if each_label else label  # the search of each label is that of no label, apart
    xyz = [c.alias(n) for c, n in zip(_cube(F.col("_lat"), F.col("_lon")), "xyz")]
    apart = bool(fold) and not each_fold  # whether the search depends on the left row's fold

    def rows_of(df: DataFrame, k: str) -> DataFrame:
        return df.select(own[0].alias("f"), own[1].alias("l"), F.col(k).alias("k"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).dropna(subset=["f", "l", "_lat", "_lon"])

    def placed(once: DataFrame) -> DataFrame:
        return settled(once.select("*", *xyz).withColumn("code", _code([F.col(c) for c in "xyz"])))

    asked = rows_of(left, key)
    asked = asked.withColumn("_l", F.col("l")).withColumn("l", F.col("l") if label else F.lit(0))
    here = placed((asked if apart else asked.withColumn("f", F.lit(0))).select("f", "l", "_lat", "_lon").distinct())
    there = placed(rows_of(right, right_key).groupBy("f", "l", "_lat", "_lon").agg(F.min("k").alias("k")))
    g = F.col("f") if each_fold else F.col("l") if each_label else F.lit(0)
    there = there.withColumn("g", g)
    levels = F.explode(F.sequence(F.lit(TOP), F.lit(DEEPEST)))
    # the most places of a cell, and the cells, on each level: a row for each level
    crowds = {r["level"]: (r["n"], r["cells"]) for r in there.groupBy("code").count().select(levels.alias("level"), "code", "count").groupBy("level", F.expr(f"shiftright(code, cast(3 * ({DEEPEST} - level) as int))").alias("c")).agg(F.sum("count").alias("n")).groupBy("level").agg(F.max("n").alias("n"), F.count("*").alias("cells")).collect()}
    last = next((lv for lv in range(TOP, DEEPEST + 1) if crowds.get(lv, (0, 0))[0] <= CROWD), DEEPEST)
    # the deepest level of no more cells than ``TOP`` may have
    first = max([lv for lv in range(TOP, last + 1) if crowds.get(lv, (0, 0))[1] <= 8**TOP], default=TOP)

    def held(level: int) -> DataFrame:
        """Right cells: for each label the least and the largest fold."""
        by_label = _nodes(there, level, ["g", "l"], [F.min("f").alias("f0"), F.max("f").alias("f1")])
        box = [f(f"{side}{c}").alias(f"r_{side}{c}") for c in "xyz" for side, f in (("lo_", F.min), ("hi_", F.max))]
        return by_label.groupBy(F.col("cell").alias("r_cell"), "g").agg(*box, F.collect_list(F.struct("l", "f0", "f1")).alias("holds"))

    def fits(x: Column) -> Column:
        out = F.lit(True)
        if apart:
            out = out & ((x["f0"] != F.col("f")) | (x["f1"] != F.col("f")))
        if label:
            out = out & ((x["l"] == F.col("l")) == F.lit(bool(alike)))
        return out

    cut = F.lit(float("inf")) if within_km is None else F.lit((2 * math.sin(min(within_km / (2 * S.EARTH_RADIUS_KM), math.pi / 2))) ** 2)
    least, most = _bounds("", "r_")
    pairs: DataFrame | None = None
    for level in range(first, last + 1):
        mine, theirs = _nodes(here, level, ["f", "l"], [F.count("*").alias("m")]), held(level)
        if pairs is None:
            met = mine.join(F.broadcast(theirs), F.exists("holds", fits))  # at most 8 ** TOP cells, by fold with each_fold
        else:
            up = pairs.select(F.col("cell").alias("_up"), "f", "l", F.col("r_cell").alias("_r_up"), "g")
            met = up.join(mine.withColumn("_up", F.shiftright("cell", 3)), ["_up", "f", "l"]).join(theirs.withColumn("_r_up", F.shiftright("r_cell", 3)), ["_r_up", "g"]).where(F.exists("holds", fits))
        # a number of tasks that goes by the pairs, of which a pair has some 16 on the next level
        tasks = 1 if pairs is None else _tasks(16 * pairs.count())
        met = met.withColumns({"_least": least, "_most": most}).repartition(tasks, "cell", "f", "l", "g")
        bound = F.least(F.min("_most").over(Window.partitionBy("cell", "f", "l", "g")), cut)
        # a margin of some millimetres above rounding
        pairs = settled(met.withColumn("_bound", bound).where(F.sqrt("_least") <= F.sqrt("_bound") + 1e-9).select("cell", "f", "l", "m", "r_cell", "g"))
    may = F.lit(True)
    may = may & (F.col("r_f") != F.col("f")) if apart else may
    may = may & ((F.col("r_l") == F.col("l")) == F.lit(bool(alike))) if label else may
    # cells meet by the fold and label of the partner, so that rows that may not meet never do
    others = there.select(F.col("f").alias("r_f"), F.col("l").alias("r_l"), "g", F.col("k").alias("r_k"), "_lat", "_lon", _at(last).alias("r_cell"))
    mine = _listed(here.select("f", "l", "_lat", "_lon", _at(last).alias("cell")), ["cell", "f", "l"], ["_lat", "_lon"], "mine")
    theirs = _listed(others, ["r_cell", "g", "r_f", "r_l"], ["_lat", "_lon", "r_k"], "theirs")
    visits = pairs.agg(F.sum("m")).first()[0] or 0
    met = pairs.join(theirs, ["r_cell", "g"]).where(may).join(mine, ["cell", "f", "l"]).repartition(_tasks(10 * visits), "cell", "f", "l")
    to = lambda p: F.array_min(F.transform("theirs", lambda q: F.struct(S.haversine_km(p["_lat"], p["_lon"], q["_lat"], q["_lon"]).alias("km"), q["r_k"].alias("r_k"))))
    each = met.select("cell", "f", "l", "g", F.inline(F.transform("mine", lambda p: F.struct(p["_lat"].alias("_lat"), p["_lon"].alias("_lon"), to(p).alias("b")))))
    best = each.groupBy("cell", "f", "l", "_lat", "_lon", "g").agg(F.min("b").alias("b"))
    best = best.where(F.col("b.km") <= within_km) if within_km is not None else best
    best = settled(best.select("f", "l", "_lat", "_lon", "g", F.col("b.km").alias("km_apart"), F.col("b.r_k").alias("_r_k")))
    if by_place:
        return best.select(*([F.col("f").alias(fold)] if apart else []), *([F.col("l").alias(label)] if label else []), F.col("_lat").alias(lat), F.col("_lon").alias(lon), *([F.col("g").alias(f"r_{fold if each_fold else wanted}")] if each_fold or each_label else []), F.col("_r_k").alias(f"r_{right_key}"), "km_apart")
    found = asked.join(best, ["f", "l", "_lat", "_lon"]) if apart else asked.join(best.drop("f"), ["l", "_lat", "_lon"])
    found = found.where(F.col("g") != F.col("f")) if each_fold else found
    return found.select(*([F.col("f").alias(fold)] if fold else []), F.col("k").alias(key), *([F.col("g").alias(f"r_{fold}")] if each_fold else [F.col("_l").alias(wanted), F.col("g").alias(f"r_{wanted}")] if each_label else []), F.col("_r_k").alias(f"r_{right_key}"), "km_apart")


#: Places of a list at most, about; only the smallest cells hold more. Rows
#: that a task sorts, about.
LIST, SORTED = 1024, 500_000


def _tasks(rows: int) -> int:
    return max(1, math.ceil(rows / SORTED))


def _listed(rows: DataFrame, by: Sequence[str], what: Sequence[str], name: str) -> DataFrame:
    """``rows`` with those of one class of ``by`` in lists of bounded length."""
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64(*what), F.lit(math.ceil(most / LIST) or 1))
    return rows.groupBy(*by, part.alias("_part")).agg(F.collect_list(F.struct(*what)).alias(name)).drop("_part")


def label_neighbours(df: DataFrame, fold: str, key: str, label: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distances of each row to the nearest row of other folds: any_km, of the
    same label and of the other; null where there is none.

    One search finds the nearest row of every label for each place and fold;
    rows meet these as one list, not once for each distance."""
    near = nearest(df, df, key, key, lat=lat, lon=lon, fold=fold, label=label, each_label=True, by_place=True)
    # a row without a label has no same or other one, and is any row's neighbour
    rest = df.where(F.col(label).isNull())
    if not rest.isEmpty():
        plain = nearest(df, df, key, key, lat=lat, lon=lon, fold=fold, by_place=True)
        near = near.unionByName(plain.withColumn(f"r_{label}", F.lit(None).cast(dict(df.dtypes)[label])))
    lists = near.groupBy(F.col(fold).alias("_f"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(F.collect_list(F.struct(F.col(f"r_{label}").alias("l"), F.col("km_apart").alias("km"))).alias("_near"))
    lists = settled(lists)  # of known size, so that few places are sent to the rows
    met = df.select(fold, key, label, F.col(lat).cast("double").alias("_a"), F.col(lon).cast("double").alias("_o"))
    met = met.join(lists, (F.col(fold) == F.col("_f")) & (F.col("_a") == F.col("_lat")) & (F.col("_o") == F.col("_lon")), "left")
    least = lambda keep: F.array_min(F.transform(F.filter("_near", keep), lambda x: x["km"]))
    return met.select(fold, key, least(lambda x: F.lit(True)).alias("any_km"), least(lambda x: x["l"] == F.col(label)).alias("same_label_km"), least(lambda x: x["l"] != F.col(label)).alias("opposite_label_km"))


def remove_buffer(train: DataFrame, test: DataFrame, key: str, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Training rows farther than ``km`` from every test row; 0 keeps all."""
    if km <= 0:
        return train
    close = within(train.select(key, lat, lon), test.select(F.col(key), lat, lon), km, lat, lon).select(key).distinct()
    return train.join(close, key, "left_anti")


#: Folds that buffers may be drawn around at once.
MOST_FOLDS = 1000


def remove_buffers(df: DataFrame, fold: str, key: str, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``remove_buffer`` for every fold as the test fold: (fold, key) of the
    rows of other folds farther than ``km`` from its rows. Folds are a bounded
    catalogue."""
    folds = [r[fold] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect() if r[fold] is not None]
    if len(folds) > MOST_FOLDS:
        raise ContractError(f"more than {MOST_FOLDS} folds")
    kind = f"array<{dict(df.dtypes)[fold]}>"
    tests, points = F.array(*[F.lit(f) for f in folds]).cast(kind), df.select(fold, key, lat, lon)
    if km > 0:
        points = with_near_folds(points, nearest(points, points, key, key, lat, lon, fold=fold, each_fold=True, within_km=km, by_place=True), F.col(f"r_{fold}"), lat, lon)
        tests = F.array_except(tests, F.coalesce("_near", F.array().cast(kind)))
    left = points.where(F.col(fold).isNotNull()).select(fold, key, F.explode(tests).alias("_test")).where(F.col(fold) != F.col("_test"))
    return left.select(F.col("_test").alias(fold), key)


def with_near_folds(df: DataFrame, near: DataFrame, what: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with ``_near``, the list of ``what`` over the rows of ``near`` (of
    ``nearest``, by place) at the row's place, null without any: a row meets
    its place once, whatever the folds."""
    lists = near.groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(F.collect_list(what).alias("_near"))  # one for each fold at most
    lists = settled(lists)  # of known size, so that few places are sent to the rows
    return df.join(lists, (F.col(lat).cast("double") == F.col("_lat")) & (F.col(lon).cast("double") == F.col("_lon")), "left").drop("_lat", "_lon")


def _tight_cells(km: float, lat: str, lon: str) -> list[Column]:
    """Grid cell of a point (row, column) so small that any two points of a
    cell are at most ``km`` apart: its sides are those of a square whose
    diagonal is the chord of ``km``, measured at its widest latitude."""
    side = 2 * S.EARTH_RADIUS_KM * math.sin(min(km / (2 * S.EARTH_RADIUS_KM), math.pi / 2)) / math.sqrt(2) / KM_PER_DEGREE * 0.9999
    row = F.floor((F.col(lat) + 90) / side)
    low, high = row * side - 90, (row + 1) * side - 90
    widest = F.when((low < 0) & (high > 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high), F.lit(90.0)))
    n = F.greatest(F.ceil(360 * F.cos(F.radians(widest)) / side), F.lit(1))
    return [row.cast("long").alias("_trow"), F.pmod(F.floor((F.col(lon) + 180) / (360 / n)), n).cast("long").alias("_tcol")]


def eps_components(df: DataFrame, key: str, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point's cluster under links of at most ``km``: (key, cluster), the
    smallest key of the cluster; a point without a link or place is its own.

    Points of one small cell are linked by construction, so cells, not points,
    are joined: first by their least keys, then by the points of cells that
    are near and still apart. A crowded place costs its cells, not its pairs.
    """
    p = settled(df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), *_tight_cells(km, lat, lon)))
    cells = settled(p.groupBy("_trow", "_tcol").agg(F.min_by(F.struct("id", "lat", "lon"), "id").alias("b"), F.count("*").alias("n")).select("_trow", "_tcol", F.col("b.id").alias("rep"), F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon"), "n"))
    reps = cells.select("rep", "lat", "lon", "n")
    # points of two cells within km have least points within three times that
    near = settled(within(reps, reps, 3 * km).where("rep < r_rep").select("rep", "r_rep", "n", "r_n", "km_apart"))
    found = connected(near.where(F.col("km_apart") <= km).select(F.col("rep").alias("a"), F.col("r_rep").alias("b")))
    named = settled(cells.join(found, cells["rep"] == found["node"], "left").select("_trow", "_tcol", "rep", F.coalesce("component", "rep").alias("part")))
    sides = [named.select(F.col("rep").alias(r), F.col("part").alias(q)) for r, q in (("rep", "part"), ("r_rep", "r_part"))]
    apart = near.where((F.col("n") > 1) | (F.col("r_n") > 1)).join(sides[0], "rep").join(sides[1], "r_rep").where("part <> r_part").select("rep", "r_rep", "part", "r_part")
    points = p.join(named, ["_trow", "_tcol"]).select("rep", "lat", "lon")
    other = points.select(F.col("rep").alias("r_rep"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    met = apart.join(points, "rep").join(other, "r_rep").where(S.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= km)
    last = connected(met.select(F.col("part").alias("a"), F.col("r_part").alias("b")).distinct())
    whole = named.join(last, named["part"] == last["node"], "left").select("_trow", "_tcol", F.coalesce("component", "part").alias("cluster"))
    placed = p.join(whole, ["_trow", "_tcol"]).select(F.col("id").alias("_id"), "cluster")
    return df.select(key).join(placed, F.col(key) == F.col("_id"), "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def linkage(df: DataFrame, key: str, radii: Sequence[float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Single-linkage clusters at all ``radii`` (km, above 0) from one minimum
    spanning forest: (key, cluster_<radius>...), each the smallest key of its
    cluster; a row without a place is a cluster of its own.

    Places within the least radius are one cluster to begin with. In each
    round every cluster takes its shortest edge to another one (ties by the
    keys at its ends, so that no round closes a circle), up to the largest
    radius; clusters halve at least, and rows of one never meet. A cut of the
    forest at a radius leaves that radius's clusters."""
    spark, radii = df.sparkSession, sorted(map(float, radii))
    base = settled(eps_components(df, key, radii[0], lat, lon).join(df.select(F.col(key).alias("_k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")), F.col(key) == F.col("_k")).select(F.col(key).alias("id"), F.col("cluster").alias("base"), "lat", "lon"))
    kind = dict(base.dtypes)["base"]
    forest, now = spark.createDataFrame([], f"a {kind}, b {kind}, km double"), base.withColumn("part", F.col("base"))
    while True:
        near = nearest(now, now, "id", "id", fold="part", within_km=radii[-1])
        ends = F.struct("km_apart", F.least("id", "r_id").alias("lo"), F.greatest("id", "r_id").alias("hi"))
        taken = settled(near.groupBy("part").agg(F.min(ends).alias("e")).select(F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"), F.col("e.km_apart").alias("km")).distinct())
        if taken.isEmpty():
            break
        end = lambda c: now.select(F.col("id").alias(c), F.col("base").alias(f"base_{c}"), F.col("part").alias(f"part_{c}"))
        named = settled(taken.join(end("lo"), "lo").join(end("hi"), "hi"))
        forest = settled(forest.unionByName(named.select(F.col("base_lo").alias("a"), F.col("base_hi").alias("b"), "km")))
        merged = connected(named.select(F.col("part_lo").alias("a"), F.col("part_hi").alias("b")))
        now = settled(now.join(merged, now["part"] == merged["node"], "left").select("id", "base", "lat", "lon", F.coalesce("component", "part").alias("part")))
    out = base.select("id", "base")
    for r in radii:
        cut = connected(forest.where(F.col("km") <= r)).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        out = out.join(cut, F.col("base") == F.col("_n"), "left").withColumn(f"cluster_{r:g}", F.coalesce("_c", "base")).drop("_n", "_c")
    return out.withColumnRenamed("id", key).drop("base")


def grid_cell(points: DataFrame, cells: DataFrame, key: str, half: float = 0.25, slack: float = 1e-6, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The nearest cell centre of each point and whether its box holds the
    point: key, cell, in_cell. Cells (cell, lat, lon) are met by 1-degree
    bucket, as lists, so that a point stays one row; a point without a centre
    in the nine buckets around has none."""
    bucket = lambda df, d: df.withColumns({"_bx": F.explode(F.array(*[(F.floor(lon) + i).cast("long") for i in d]))}).withColumn("_by", F.explode(F.array(*[(F.floor(lat) + i).cast("long") for i in d])))
    c = _listed(bucket(cells.select("cell", lat, lon), (-1, 0, 1)), ["_bx", "_by"], ["cell", lat, lon], "_cells")
    p = bucket(points.select(key, lat, lon), (0,))
    d2 = lambda q: F.pow(F.col(lat) - q[lat], 2) + F.pow(F.col(lon) - q[lon], 2)
    first = F.array_min(F.transform("_cells", lambda q: F.struct(d2(q).alias("d2"), q["cell"].alias("cell"), q[lat].alias("c_lat"), q[lon].alias("c_lon"))))
    best = p.join(c, ["_bx", "_by"], "left").select(key, lat, lon, first.alias("b")).groupBy(key, lat, lon).agg(F.min("b").alias("b"))  # a row for each list
    inside = (F.abs(F.col(lat) - F.col("b.c_lat")) <= half + slack) & (F.abs(F.col(lon) - F.col("b.c_lon")) <= half + slack)
    return best.select(key, F.col("b.cell").alias("cell"), F.coalesce(inside, F.lit(False)).alias("in_cell"))
