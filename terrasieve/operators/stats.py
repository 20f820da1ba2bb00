"""Statistics: robust scaling, effects, rank correlation, ridge residuals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import settled
from . import ranges

TINY = 1e-12


def robust_z_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: quartiles, mean and sample deviation of each column. Quartiles
    come from counts of different values, summed by ranges."""
    plain = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))])
    q = ranges.quantiles(long_form(df, [], columns), ["concept"], "value", (0.25, 0.5, 0.75))
    wide = q.agg(*[F.max(F.when(F.col("concept") == c, F.col("q"))).alias(f"q_{c}") for c in columns])
    return plain.crossJoin(wide)


def robust_z(column: str) -> Column:
    """(x - median) / IQR from ``robust_z_stats``; without an IQR the z-score,
    without a deviation 0; clipped to 8 either way."""
    x, q = F.col(column).cast("double"), F.col(f"q_{column}")
    iqr = q[2] - q[0]
    sd = F.coalesce(F.col(f"sd_{column}"), F.lit(0.0))
    flat = F.when(sd > TINY, (x - F.col(f"avg_{column}")) / F.nullif(sd, F.lit(0.0))).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
    return F.when(x.isNotNull(), S.clipped(F.when(iqr >= TINY, (x - q[1]) / F.nullif(iqr, F.lit(0.0))).otherwise(flat)))


def with_robust_z(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add the robust z of each column; the statistics are one row."""
    stats = robust_z_stats(df, columns)
    extra = [f"{p}_{c}" for c in columns for p in ("q", "avg", "sd")]
    return df.crossJoin(F.broadcast(stats)).withColumns({f"{c}{suffix}": robust_z(c) for c in columns}).drop(*extra)


def class_cells(df: DataFrame, by: Sequence[str], label: str, value: str, weight: str | None = None) -> DataFrame:
    """One row for each different value of a group with its counts by class,
    _p and _n, and the counts of smaller values, _pb and _nb."""
    one = F.col(weight) if weight else F.lit(1)
    clean = df.where(F.col(label).isNotNull() & F.col(value).isNotNull() & (one > 0))
    counts = clean.groupBy(*by, value).agg(F.sum(F.when(F.col(label) == 1, one).otherwise(0)).cast("long").alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(one)).cast("long").alias("_n"))
    return ranges.running_sums(counts, by, [value], {"_pb": "_p", "_nb": "_n"})


def won_pairs() -> Column:
    """Aggregate over ``class_cells``: pairs of a positive and a negative row
    that the positive one wins, ties half."""
    return F.sum(F.col("_p") * (F.col("_nb") + F.col("_n") / 2))


def auc_by(df: DataFrame, by: Sequence[str], label: str = "y", value: str = "value", weight: str | None = None) -> DataFrame:
    """by, n_pos, n_neg, auc: rank-sum AUC over non-null pairs of a long
    table; null without both classes. ``weight`` counts a row so many times,
    as resamples need."""
    out = class_cells(df, by, label, value, weight).groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), won_pairs().alias("_won"))
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_won"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def poisson_weight(iteration: Column | int, *key: Column, seed: int = 0) -> Column:
    """Times that a row is drawn in a resample: Poisson of mean 1 by a hash of
    iteration and key. It stands for draws with replacement where the rows of
    a class are too many to draw in one place."""
    u = F.pmod(F.xxhash64(F.lit(iteration), *key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(8):
        total += p
        steps.append(F.lit(total))
        p /= k + 1
    return sum(((u >= t).cast("int") for t in steps), F.lit(0))


def selection_rates(df: DataFrame, env: str, label: str, columns: Sequence[str], weight, iterations: int = 100, top_k: int = 12, min_class: int = 10) -> DataFrame:
    """How often each column is among the ``top_k`` strongest (2 |AUC - 1/2|,
    ties in the order of ``columns``) in resamples of each environment.

    ``weight(iteration)``, of an iteration's number, gives a row's times in
    that resample. Environments with fewer than ``min_class`` rows of a class
    are left out. Nothing is multiplied out over the iterations: a row carries
    its times in all resamples as bytes."""
    counts = df.groupBy(F.col(env).alias("env")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    able = counts.where((F.col("p") >= min_class) & (F.col("n") >= min_class)).select("env")
    drawn = F.array(*[F.coalesce(weight(i).cast("int"), F.lit(0)) for i in range(iterations)])
    rows = df.where(F.col(label).isNotNull()).select(F.col(env).alias("env"), (F.col(label) == 1).alias("y"), drawn.alias("times"), *[x for i, c in enumerate(columns) for x in (F.col(c).cast("double").alias(f"v{i}"), F.col(c).isNotNull().alias(f"has{i}"))])
    # a few environments, sent to the rows: a guess of their size would shuffle all times for them
    auc = _drawn_aucs(rows.join(F.broadcast(able), "env", "left_semi"), list(columns), iterations)
    strength = F.coalesce(F.round(F.abs(F.col("auc") - 0.5), 12), F.lit(-1.0))
    place = F.row_number().over(Window.partitionBy("env", "iteration").orderBy(strength.desc(), F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("concept"))))
    return auc.withColumn("_place", place).groupBy("env", "concept").agg(F.avg((F.col("_place") <= top_k).cast("double")).alias("selection_rate"), F.count("*").alias("n_iterations"))


def packed_times(times: np.ndarray) -> list[bytes]:
    """Each row's times as bytes: two bits for each, and those from three on
    in full after them, of one byte (of four, where the row has one above 255)."""
    low = np.zeros((len(times), -(-times.shape[1] // 4) * 4), dtype=np.uint8)
    low[:, : times.shape[1]] = np.minimum(times, 3)
    bits = (low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6).tobytes()
    high, width = times >= 3, low.shape[1] // 4
    values, ends = times[high], np.cumsum(high.sum(axis=1)).tolist()
    bytes_, wide = np.minimum(values, 255).astype(np.uint8).tobytes(), (times > 255).any(axis=1).tolist()
    return [bits[i * width : (i + 1) * width] + (values[a:b].astype(np.int32).tobytes() if w else bytes_[a:b]) for i, (a, b, w) in enumerate(zip([0, *ends], ends, wide))]


def unpacked_times(packed: Sequence[bytes], small: np.ndarray, iterations: int) -> np.ndarray:
    """(rows, iterations) from ``packed_times``; ``small`` marks the rows
    whose times are of a byte at most."""
    width = -(-iterations // 4)
    bits = np.frombuffer(b"".join([p[:width] for p in packed]), np.uint8).reshape(-1, width)
    out = np.stack([bits >> k & 3 for k in (0, 2, 4, 6)], axis=2).reshape(len(bits), -1)[:, :iterations].astype(np.int64)
    high = out == 3
    rest = [p[width:] for p in packed]
    narrow = high & small[:, None]
    out[narrow] = np.frombuffer(b"".join([p for p, s in zip(rest, small) if s]), np.uint8)
    out[high & ~small[:, None]] = np.frombuffer(b"".join([p for p, s in zip(rest, small) if not s]), np.int32)
    return out


def _drawn_aucs(rows: DataFrame, columns: Sequence[str], iterations: int) -> DataFrame:
    """(env, concept, iteration, auc) of rows (env, y, times, v0, has0, v1,
    ...) in all resamples; those that draw no row with a value are left out.

    Each task adds up its rows of equal environment, column, value and class
    and packs their sums in some bits; these meet by ranges of values. Within a
    range all resamples are ranked at once, and pairs of rows of two ranges
    are won by the later one, so ranges need their sums alone."""
    kind, k = dict(rows.dtypes)["env"], len(columns)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b for b in batches if len(b)):
            times = np.stack(batch["times"].to_numpy()).astype(np.int32)
            for i in range(k):
                at = np.flatnonzero(batch[f"has{i}"].to_numpy())
                if len(at):
                    part = batch.iloc[at]
                    number = part.groupby(["env", f"v{i}", "y"], dropna=False).ngroup().to_numpy()
                    order = np.argsort(number, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(number[order]) > 0]))
                    sums = np.add.reduceat(times[at[order]], first, axis=0)
                    key, small = part.iloc[order[first]], sums.max(axis=1) < 256
                    yield pd.DataFrame({"env": key["env"].to_numpy(), "concept": i, "value": key[f"v{i}"].to_numpy(), "tag": 2 * key["y"].to_numpy(bool) + small, "times": packed_times(sums)})

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}  # first value, positive, negative and won of each resample, and the last value with its own rows
        for batch in (b for b in batches if len(b)):
            for (e, c), part in batch.groupby(["env", "concept"], sort=False):
                v, y, small = part["value"].to_numpy(), part["tag"].to_numpy() > 1, part["tag"].to_numpy() % 2 == 1
                times = unpacked_times(part["times"].to_list(), small, iterations)
                s = sums.setdefault((e, int(c)), [v[0], *np.zeros((3, iterations)), v[0], *np.zeros((2, iterations), dtype=np.int64)])
                v, p, n = np.concatenate([[s[4]], v]), np.vstack([s[5], times * y[:, None]]), np.vstack([s[6], times * ~y[:, None]])
                first = np.flatnonzero(np.concatenate([[True], ~((v[1:] == v[:-1]) | np.isnan(v[1:]) & np.isnan(v[:-1]))]))
                p, n = np.add.reduceat(p, first, axis=0), np.add.reduceat(n, first, axis=0)
                s[4:], p, n = [v[-1], p[-1], n[-1]], p[:-1], n[:-1]
                s[3] = s[3] + (p * (s[2] + np.cumsum(n, axis=0) - n / 2)).sum(axis=0)
                s[1], s[2] = s[1] + p.sum(axis=0), s[2] + n.sum(axis=0)
        for (e, c), (first, p, n, won, _, lp, ln) in sums.items():
            yield pd.DataFrame({"env": [e], "concept": [c], "first": [first], "p": [p + lp], "n": [n + ln], "won": [won + lp * (n + ln / 2)]})

    cells = rows.mapInPandas(packed, f"env {kind}, concept int, value double, tag int, times binary")
    number = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  (pandas gives none for it)
    # written, as the search for the ranges' bounds would make all times again
    cells = settled(cells.withColumn("value", number("value")))
    # a range holds whole values: equal ones have one place in the order
    dealt = cells.repartitionByRange("env", "concept", "value").sortWithinPartitions("env", "concept", "value")
    parts = settled(dealt.mapInPandas(ranked, f"env {kind}, concept int, first double, p array<double>, n array<double>, won array<double>"))
    each = parts.select("env", "concept", number("first").alias("first"), F.posexplode(F.arrays_zip("p", "n", "won")).alias("iteration", "s")).select("env", "concept", "first", "iteration", "s.*")
    before = Window.partitionBy("env", "concept", "iteration").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    met = each.withColumn("won", F.col("won") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    out = met.groupBy("env", "concept", "iteration").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("won").alias("won")).where("p + n > 0")
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("concept") + 1)
    return out.select("env", named.alias("concept"), "iteration", F.try_divide(F.col("won"), F.col("p") * F.col("n")).alias("auc"))


def mean_feature_spearman(df: DataFrame, pairs: dict[str, str], min_pairs: int = 30) -> DataFrame:
    """Mean Spearman correlation of recovered columns with their references
    {recovered: reference}; pairs too few or constant are left out."""
    found = [spearman_pairs(df, [a], [b], min_pairs) for a, b in pairs.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.agg(F.avg("spearman").alias("mean_spearman"), F.count("spearman").alias("n_features"))


def cohen_d(n1: Column, m1: Column, v1: Column, n0: Column, m0: Column, v0: Column) -> Column:
    """Pooled (ddof 1); null for fewer than 2 in a class, 0 without variance."""
    pooled = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
    return F.when((n1 < 2) | (n0 < 2), None).when(pooled <= TINY, 0.0).otherwise((m1 - m0) / F.sqrt(pooled))


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "concept", value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), list(columns), name, value)


def feature_effects(df: DataFrame, env: str, label: str, columns: Sequence[str]) -> DataFrame:
    """Effects of each column in each environment: class sizes, differences of
    mean and median, Cohen's d, AUC and its strength, direction, missing rate.

    Medians and AUC come from one table of counts of different values."""
    keys = ["env", "concept"]
    long = long_form(df.select(F.col(env).alias("env"), F.col(label).alias("y"), *columns), ["env", "y"], columns)
    pos, neg = F.col("y") == 1, F.col("y") == 0
    of = lambda c: F.when(c, F.col("value"))
    sums = long.groupBy(*keys).agg(
        F.count(of(pos)).alias("n1"), F.count(of(neg)).alias("n0"), F.avg(of(pos)).alias("m1"), F.avg(of(neg)).alias("m0"),
        F.var_samp(of(pos)).alias("v1"), F.var_samp(of(neg)).alias("v0"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
    )
    cells = class_cells(long, keys, "y", "value")
    cells = ranges.join_groups(cells, cells.groupBy(*keys).agg(F.sum("_p").alias("_np"), F.sum("_n").alias("_nn")), keys)
    ranked = cells.groupBy(*keys).agg(
        F.try_divide(won_pairs(), F.max(F.col("_np") * F.col("_nn"))).alias("auc"),
        ranges.interpolated("_pb", "_p", "value", F.col("_np"), 0.5).alias("d1"), ranges.interpolated("_nb", "_n", "value", F.col("_nn"), 0.5).alias("d0"),
    )
    # environments without any value of a column still have their row
    joined = sums.join(ranked.select(F.col("env").alias("_e"), F.col("concept").alias("_k"), "auc", "d1", "d0"), F.col("env").eqNullSafe(F.col("_e")) & (F.col("concept") == F.col("_k")), "left")
    diff = F.col("m1") - F.col("m0")
    return joined.select(
        "env", "concept", F.col("n1").alias("n_positive"), F.col("n0").alias("n_negative"), diff.alias("mean_difference"), (F.col("d1") - F.col("d0")).alias("median_difference"),
        cohen_d(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n0"), F.col("m0"), F.col("v0")).alias("cohen_d"), "auc", (2 * F.abs(F.col("auc") - 0.5)).alias("auc_strength"),
        F.when(diff > 0, "positive_higher").otherwise("negative_higher").alias("direction"), "missing_rate",
    )


#: Up to so many pairs are ranked pair by pair; of more, those whose columns
#: lack the same rows share one ranking of each column.
MOST_PAIRS = 64


def spearman_pairs(df: DataFrame, targets: Sequence[str], covariates: Sequence[str], min_pairs: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of each target with each covariate over the rows
    that have both (ranks are those among these rows).

    Rows: by, target, covariate, n_pairs, spearman (null under ``min_pairs``
    pairs or for a constant side). Two columns that lack values in the same
    rows are ranked alike in all their pairs; only other pairs of a wide table
    are multiplied out. ``by`` is a bounded catalogue."""
    pairs = [(t, c) for t in targets for c in covariates if t != c]
    if len(pairs) <= MOST_PAIRS:
        return _ranked_apart(df, pairs, min_pairs, by)
    shared = _same_rows(df, pairs)
    apart = [p for p in pairs if p not in shared]
    parts = ([_ranked_once(df, sorted(shared), min_pairs, by)] if shared else []) + ([_ranked_apart(df, apart, min_pairs, by)] if apart else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _same_rows(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> set[tuple[str, str]]:
    """The pairs of columns that have values in the same rows."""
    names = sorted({c for p in pairs for c in p})
    g = gram(df, [F.col(c).isNotNull().cast("double") for c in names], names)
    both = np.rint(g.n * (g.cov + np.outer(g.mean, g.mean)))
    at = {c: i for i, c in enumerate(names)}
    return {(a, b) for a, b in pairs if both[at[a], at[b]] == both[at[a], at[a]] == both[at[b], at[b]]}


def _ranked_once(df: DataFrame, pairs: Sequence[tuple[str, str]], min_pairs: int, by: Sequence[str]) -> DataFrame:
    """Each column ranked once, centred, missing values 0, and all products of
    the ranks summed in blocks of rows."""
    names = sorted({c for p in pairs for c in p})
    held = settled(df.select(*by, *[F.col(c).cast("double").alias(c) for c in names], F.monotonically_increasing_id().alias("_id")))
    key = [*by, "concept"]
    long = long_form(held, [*by, "_id"], names).where("value is not null")
    cells = ranges.running_sums(long.groupBy(*key, "value").agg(F.count("*").alias("_c")), key, ["value"], {"_below": "_c"})
    cells = ranges.join_groups(cells, cells.groupBy(*key).agg(F.sum("_c").alias("_n")), key).withColumn("_x", F.col("_below") + (F.col("_c") - F.col("_n")) / 2)
    at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("concept")) - 1
    met = ranges.join_groups(long, cells.select(*key, "value", "_x"), [*key, "value"])
    rows = met.groupBy(*by, "_id").agg(F.collect_list(F.struct(at.cast("int").alias("i"), F.col("_x").alias("x"))).alias("_v")).select(*by, F.col("_v.i").alias("_at"), F.col("_v.x").alias("_rank"))
    k = len(names)

    def matrix(_key: tuple, part: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(part), k))
        out[np.repeat(np.arange(len(part)), part["_at"].map(len)), np.concatenate(part["_at"].tolist())] = np.concatenate(part["_rank"].tolist())
        return out

    counts = {(*(r[c] for c in by), r["concept"]): r["_n"] for r in cells.groupBy(*key).agg(F.max("_n").alias("_n")).collect()}
    index, out = {c: i for i, c in enumerate(names)}, []
    for group, sums in _block_products(rows, by, k, matrix).items():
        for a, b in pairs:
            i, j, n = index[a], index[b], counts.get((*group, a), 0)
            fine = n >= min_pairs and sums[i, i] > TINY and sums[j, j] > TINY
            if n:
                out.append((*group, a, b, int(n), float(sums[i, j] / math.sqrt(sums[i, i] * sums[j, j])) if fine else None))
    types = "".join(f"{c} {t}, " for c, t in df.select(*by).dtypes)
    return df.sparkSession.createDataFrame(out, types + "target string, covariate string, n_pairs long, spearman double")


#: A column of at most so many different values, about, is the narrow side of
#: a pair: its ranks are sent to the rows, which then meet by the other side.
NARROW = 10_000


def narrow_sides(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[list[tuple[str, str, bool]], list[tuple[str, str]]]:
    """Pairs with a narrow column, as (wide, narrow, whether the target is the
    wide one), and the others. The count is a guess, on which no result rests."""
    names = sorted({c for p in pairs for c in p})
    if not names:
        return [], []
    n = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first().asDict()
    met = [(t, c, True) if n[c] <= n[t] else (c, t, False) for t, c in pairs]
    return [m for m in met if n[m[1]] <= NARROW], [p for p, m in zip(pairs, met) if n[m[1]] > NARROW]


def numbered_pairs(df: DataFrame, keep: Sequence[str], met: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(keep, _pair, a, b): the values of every pair by its number, wide side
    first, in rows that have both."""
    pairs = [F.struct(F.lit(i).alias("_pair"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")) for i, (x, y, _) in enumerate(met)]
    return df.select(*keep, F.inline(F.array(*pairs))).where("a is not null and b is not null")


def pair_names(met: Sequence[tuple[str, str, bool]]) -> list[Column]:
    """Target and covariate of ``_pair``."""
    of = lambda names: F.get(F.array(*[F.lit(n) for n in names]), F.col("_pair"))
    return [of([x if first else y for x, y, first in met]).alias("target"), of([y if first else x for x, y, first in met]).alias("covariate")]


def _ranked_apart(df: DataFrame, wanted: Sequence[tuple[str, str]], min_pairs: int, by: Sequence[str]) -> DataFrame:
    """Each pair ranked by itself. Pairs with a narrow column: its values are
    counted and ranked, rows take their ranks and are summed by values of the
    other column, which carry a count and a sum. Others: by pairs of values."""
    met, rest = narrow_sides(df, wanted)
    parts = ([_ranked_narrow(df, met, min_pairs, by)] if met else []) + ([_ranked_wide(df, rest, min_pairs, by)] if rest or not met else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _ranked_narrow(df: DataFrame, met: Sequence[tuple[str, str, bool]], min_pairs: int, by: Sequence[str]) -> DataFrame:
    long, key = numbered_pairs(df, by, met), [*by, "_pair"]

    def centred(counts: DataFrame) -> DataFrame:
        """The middle rank of each value less the middle of all ranks."""
        run = ranges.running_sums(counts, key, [counts.columns[len(key)]], {"_below": "_c"})
        run = ranges.join_groups(run, run.groupBy(*key).agg(F.sum("_c").alias("_n")), key)
        return run.withColumn("_x", F.col("_below") + (F.col("_c") - F.col("_n")) / 2)

    narrow = settled(centred(long.groupBy(*key, "b").agg(F.count("*").alias("_c"))).select(*key, "b", "_c", "_n", F.col("_x").alias("_y")))
    rows = ranges.join_groups(long, narrow.select(*key, "b", "_y"), [*key, "b"])
    wide = centred(rows.groupBy(*key, "a").agg(F.count("*").alias("_c"), F.sum("_y").alias("_sy")))
    sums = wide.groupBy(*key).agg(F.max("_n").alias("n_pairs"), F.sum(F.col("_c") * F.col("_x") * F.col("_x")).alias("va"), F.sum(F.col("_x") * F.col("_sy")).alias("cov"))
    sums = ranges.join_groups(sums, narrow.groupBy(*key).agg(F.sum(F.col("_c") * F.col("_y") * F.col("_y")).alias("vb")), key)
    rho = F.when((F.col("n_pairs") >= min_pairs) & (F.col("va") > TINY) & (F.col("vb") > TINY), F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))
    return sums.select(*by, *pair_names(met), "n_pairs", rho.alias("spearman"))


def _ranked_wide(df: DataFrame, wanted: Sequence[tuple[str, str]], min_pairs: int, by: Sequence[str]) -> DataFrame:
    """Each pair ranked by itself: rows by pairs, which pre-aggregate to counts
    of different pairs of values before the shuffle."""
    pairs = [F.struct(F.lit(t).alias("target"), F.lit(c).alias("covariate"), F.col(t).cast("double").alias("a"), F.col(c).cast("double").alias("b")) for t, c in wanted]
    long = df.select(*by, F.inline(F.array(*pairs))).where("a is not null and b is not null")
    key = [*by, "target", "covariate"]
    cells = settled(long.groupBy(*key, "a", "b").agg(F.count("*").alias("n")))

    def ranked(side: str) -> DataFrame:
        counts = cells.groupBy(*key, side).agg(F.sum("n").alias("c"))
        return ranges.running_sums(counts, key, [side], {"_below": "c"}).select(*key, side, (F.col("_below") + (F.col("c") + 1) / 2).alias(f"r_{side}"))

    joined = ranges.join_groups(ranges.join_groups(cells, ranked("a"), [*key, "a"]), ranked("b"), [*key, "b"])
    n, ra, rb = F.col("n"), F.col("r_a"), F.col("r_b")
    sums = joined.groupBy(*key).agg(
        F.sum("n").alias("n_pairs"), F.sum(n * ra).alias("sa"), F.sum(n * rb).alias("sb"), F.sum(n * ra * ra).alias("saa"), F.sum(n * rb * rb).alias("sbb"), F.sum(n * ra * rb).alias("sab")
    )
    m = F.col("n_pairs")
    cov, va, vb = F.col("sab") - F.col("sa") * F.col("sb") / m, F.col("saa") - F.col("sa") * F.col("sa") / m, F.col("sbb") - F.col("sb") * F.col("sb") / m
    rho = F.when((m >= min_pairs) & (va > TINY) & (vb > TINY), cov / F.sqrt(va * vb))
    return sums.select(*key, "n_pairs", rho.alias("spearman"))


def spearman_screen(pairs: DataFrame, threshold: float = 0.30, by: Sequence[str] = (), covariates: Sequence[str] = ()) -> DataFrame:
    """For each target the covariate of largest absolute correlation, and
    whether it reaches ``threshold``. Ties go to the first in ``covariates``
    (the order of the columns), those not in it last and by name. Correlations
    that differ in the last digits of their sums alone are ties."""
    size = F.abs("spearman")
    place = F.nullif(F.array_position(F.array(*[F.lit(c) for c in covariates]).cast("array<string>"), F.col("covariate")), F.lit(0).cast("long"))
    w = Window.partitionBy(*by, "target").orderBy(F.desc_nulls_last(F.round(size, 10)), F.asc_nulls_last(place), "covariate")
    best = pairs.withColumn("_nth", F.row_number().over(w)).where("_nth = 1")
    return best.select(
        *by, F.col("target").alias("target_column"), F.when(size.isNotNull(), F.col("covariate")).alias("best_climate_column"), "spearman", size.alias("spearman_abs_max"),
        F.col("n_pairs").alias("n_pair_at_best"), F.coalesce(size >= threshold, F.lit(False)).alias("is_spearman_sensitive"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate; null for fewer than 3 pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.count(a) >= 3) & (F.stddev_pop(a) > TINY) & (F.stddev_pop(b) > TINY), F.corr(a, b))


def pairwise_counts(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Rows in which both columns of a pair hold a value, one pass."""
    cells = [(a, b) for a in left for b in right]
    sums = df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(cells)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(cells)])))


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) by the regularised incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    # continued fraction, evaluated from the front (modified Lentz)
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


@dataclass
class Gram:
    """Sums of products of some columns (nulls filled), from one pass."""

    names: list[str]
    n: float
    mean: np.ndarray
    cov: np.ndarray  # population covariance

    def scaled(self) -> Gram:
        """The same of columns with mean 0 and deviation 1; constant ones stay 0."""
        sd = np.sqrt(np.maximum(np.diag(self.cov), 0))
        s = np.where(sd > TINY, sd, 1.0)
        return Gram(self.names, self.n, np.zeros(len(s)), self.cov / np.outer(s, s))

    def part(self, names: Sequence[str]) -> Gram:
        at = [self.names.index(c) for c in names]
        return Gram(list(names), self.n, self.mean[at], self.cov[np.ix_(at, at)])


#: Up to so many different products are plain aggregates; more are matrix
#: products of row blocks, as a plan of thousands of expressions compiles badly.
MOST_PRODUCTS = 120


def _block_products(frame: DataFrame, by: Sequence[str], k: int, matrix: Callable[[tuple, pd.DataFrame], np.ndarray]) -> dict[tuple, np.ndarray]:
    """Sums of products of the k columns that ``matrix`` makes of some rows of
    a group: every task adds up its batches and gives one row for each group
    and column, which are summed column by column; k x k numbers a group are
    what the driver gets."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for batch in (b for b in batches if len(b)):
            for key, part in batch.groupby(list(by), dropna=False) if by else [((), batch)]:
                key = tuple(None if v != v else v for v in key)
                x = matrix(key, part)
                total[key] = total.get(key, 0) + x.T @ x
        for key, m in total.items():
            yield pd.DataFrame({**{c: pd.Series([v] * k, dtype=object) for c, v in zip(by, key)}, "_i": np.arange(k), "_row": list(m)})

    types = "".join(f"{c} {t}, " for c, t in frame.select(*by).dtypes) + "_i int, _row array<double>"
    # each number is summed apart, so no group holds the rows of all tasks
    long = frame.mapInPandas(work, types).select(*by, "_i", F.posexplode("_row").alias("_j", "_v"))
    sums = long.groupBy(*by, "_i", "_j").agg(F.sum("_v").alias("_v"))
    out: dict[tuple, np.ndarray] = {}
    for r in sums.groupBy(*by, "_i").agg(F.collect_list(F.struct("_j", "_v")).alias("_r")).collect():
        row = out.setdefault(tuple(r[c] for c in by), np.zeros((k, k)))[r["_i"]]
        for j, v in r["_r"]:
            row[j] = v
    return out


def added(parts: DataFrame, n: int, k: int) -> np.ndarray:
    """(n, k): sums of the rows (_i, _row) of a few matrices that each task
    gives; each number is summed apart, so no group holds all tasks' rows."""
    long = parts.select("_i", F.posexplode("_row").alias("_j", "_v")).where("_v <> 0")
    out = np.zeros((n, k))
    for r in long.groupBy("_i", "_j").agg(F.sum("_v").alias("_v")).groupBy("_i").agg(F.collect_list(F.struct("_j", "_v")).alias("_r")).collect():
        for j, v in r["_r"]:
            out[r["_i"], j] = v
    return out


def fold_products(rows: DataFrame, k: int, n_folds: int) -> np.ndarray:
    """(n_folds, k, k): sums of products over the rows (_own, _x) outside each
    fold, where _x holds the fold's values of the first column in all folds,
    then those of the second, and so on; _own is the row's fold or -1."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_folds, k, k))
        for batch in (b for b in batches if len(b)):
            x, own = np.array(batch["_x"].tolist()).reshape(len(batch), k, n_folds), batch["_own"].to_numpy()
            for f in range(n_folds):
                part = x[own != f, :, f]
                total[f] += part.T @ part
        yield pd.DataFrame({"_i": np.arange(n_folds * k), "_row": list(total.reshape(-1, k))})

    return added(rows.mapInPandas(work, "_i int, _row array<double>"), n_folds * k, k).reshape(n_folds, k, k)


def gram_by(df: DataFrame, by: Sequence[str], columns: Sequence[Column], names: Sequence[str]) -> dict[tuple, Gram]:
    """``Gram`` of each group of ``by`` (a bounded catalogue). A first pass
    gives the means, a second the centred products, so that large means cost
    no precision; what reaches the driver is k x k numbers a group."""
    k = len(columns)
    frame = df.select(*by, *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    first = frame.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).collect()
    counts = {tuple(r[c] for c in by): float(r["n"]) for r in first}
    means = {tuple(r[c] for c in by): np.array([r[f"m{i}"] or 0.0 for i in range(k)]) for r in first}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if len(pairs) > MOST_PRODUCTS:
        sums = _block_products(frame, by, k, lambda key, part: part[[f"c{i}" for i in range(k)]].to_numpy(float) - means[key])
        return {key: Gram(list(names), n, means[key], sums[key] / n if n else np.zeros((k, k))) for key, n in counts.items()}
    table = df.sparkSession.createDataFrame(
        [(*key, *map(float, m)) for key, m in means.items()], ", ".join([*[f"_g_{c} {t}" for c, t in frame.select(*by).dtypes], *[f"_m{i} double" for i in range(k)]])
    )
    centred = frame.join(F.broadcast(table), ranges.same_group(frame, by, "_g_")) if by else frame.crossJoin(F.broadcast(table))
    d = lambda i: F.col(f"c{i}") - F.col(f"_m{i}")
    out = {key: Gram(list(names), n, means[key], np.zeros((k, k))) for key, n in counts.items()}
    for r in centred.groupBy(*by).agg(*[F.avg(d(i) * d(j)).alias(f"p{x}") for x, (i, j) in enumerate(pairs)]).collect():
        for x, (i, j) in enumerate(pairs):
            g = out[tuple(r[c] for c in by)]
            g.cov[i, j] = g.cov[j, i] = r[f"p{x}"] or 0.0
    return out


def gram(df: DataFrame, columns: Sequence[Column], names: Sequence[str]) -> Gram:
    """``gram_by`` over all rows."""
    k = len(columns)
    return gram_by(df, [], columns, names).get((), Gram(list(names), 0.0, np.zeros(k), np.zeros((k, k))))


def medians_by(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> dict[tuple, dict[str, float]]:
    """Medians of each group of ``by`` (a bounded catalogue); columns without
    a value count as 0."""
    if not columns:
        return {}
    out: dict[tuple, dict[str, float]] = {}
    for r in ranges.quantiles(long_form(df, by, columns), [*by, "concept"], "value", (0.5,)).collect():
        out.setdefault(tuple(r[c] for c in by), dict.fromkeys(columns, 0.0))[r["concept"]] = float(r["q"][0])
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return medians_by(df, [], columns).get((), dict.fromkeys(columns, 0.0))


@dataclass
class Residualizer:
    """Ridge of each target on covariates; residual = observed - predicted.

    Fitted on the training rows only: covariates are median-imputed and
    scaled by population deviation (0 counts as 1), targets median-filled, the
    intercept is not penalised. ``transform`` adds ``<target><suffix>``, built
    of plain column expressions with the training medians and scales.
    """

    targets: list[str]
    covariates: list[str]
    alpha: float = 10.0
    suffix: str = "_climate_resid"
    medians: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    intercept: np.ndarray | None = None
    weights: np.ndarray | None = None  # covariates x targets

    def fit(self, df: DataFrame) -> Residualizer:
        names = [*self.covariates, *self.targets]
        self.medians = medians(df, names)
        g = gram(df, [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in names], names)
        k = len(self.covariates)
        sd = np.sqrt(np.maximum(np.diag(g.cov)[:k], 0))
        self.mean, self.scale = g.mean[:k], np.where(sd > TINY, sd, 1.0)
        zz = g.n * g.cov[:k, :k] / np.outer(self.scale, self.scale)
        zy = g.n * g.cov[:k, k:] / self.scale[:, None]
        self.weights = np.linalg.solve(zz + self.alpha * np.eye(k), zy)
        self.intercept = g.mean[k:]
        return self

    def predicted(self, j: int) -> Column:
        out = F.lit(float(self.intercept[j]))
        for i, c in enumerate(self.covariates):
            z = (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - float(self.mean[i])) / float(self.scale[i])
            out = out + z * float(self.weights[i, j])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{t}{self.suffix}": F.coalesce(F.col(t).cast("double"), F.lit(self.medians[t])) - self.predicted(j) for j, t in enumerate(self.targets)})


def ridge_partial_corr(g: Gram, a: str, b: str, alpha: float = 1.0) -> tuple[float, float]:
    """Correlation of the residuals of two columns after a ridge on all other
    columns of ``g``, and its two-sided p; both from the products alone."""
    i, j = g.names.index(a), g.names.index(b)
    rest = [k for k in range(len(g.names)) if k not in (i, j)]
    c = g.cov * g.n
    w = np.linalg.solve(c[np.ix_(rest, rest)] + alpha * np.eye(len(rest)), c[np.ix_(rest, [i, j])]) if rest else np.zeros((0, 2))
    s = c[np.ix_([i, j], [i, j])] - w.T @ c[np.ix_(rest, [i, j])] - c[np.ix_([i, j], rest)] @ w + w.T @ c[np.ix_(rest, rest)] @ w
    if g.n <= (len(rest) + 3 if rest else 2) or s[0, 0] <= TINY or s[1, 1] <= TINY:
        return float("nan"), float("nan")
    r = float(s[0, 1] / math.sqrt(s[0, 0] * s[1, 1]))
    dof = max(g.n - len(rest) - 2, 1)
    t = r * math.sqrt(dof / max(1 - r * r, TINY))
    return r, student_t_two_sided(t, dof)


@dataclass
class ClimateScore:
    """First principal component of scaled covariates, itself scaled by the
    training mean and deviation; the first of the largest loadings (to nine
    digits) is positive."""

    columns: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    loading: np.ndarray | None = None
    deviation: float = 1.0

    def fit(self, df: DataFrame) -> ClimateScore:
        self.medians = medians(df, self.columns)
        g = gram(df, [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.columns], self.columns)
        sd = np.sqrt(np.maximum(np.diag(g.cov), 0))
        self.mean, self.scale = g.mean, np.where(sd > TINY, sd, 1.0)
        values, vectors = np.linalg.eigh(g.cov / np.outer(self.scale, self.scale))
        v = vectors[:, -1]
        self.loading = v * np.sign(v[np.argmax(np.abs(v) >= np.abs(v).max() - 1e-9)])
        self.deviation = math.sqrt(max(values[-1], 0.0)) or 1.0
        return self

    def score(self) -> Column:
        out = F.lit(0.0)
        for c, m, s, w in zip(self.columns, self.mean, self.scale, self.loading):
            out = out + (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - float(m)) / float(s) * float(w)
        return out / self.deviation


def contaminated(column: str, deviation: Column, score: Column, gamma: float) -> Column:
    """x + gamma * deviation * score where x is not null."""
    return F.col(column).cast("double") + F.lit(gamma) * deviation * score


def standardized_rmse(pairs: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Aggregate over (estimate, reference, scale): root mean square of
    standardised errors, all cells pooled, nulls left out."""
    errors = [F.pow((e - r) / s, 2) for e, r, s in pairs]
    total = sum((F.coalesce(F.sum(x), F.lit(0.0)) for x in errors), F.lit(0.0))
    count = sum((F.count(x) for x in errors), F.lit(0))
    return F.sqrt(F.try_divide(total, count))


def min_max_scaled(df: DataFrame, columns: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with {name: column} scaled to 0..1 over all rows of a group: 0 where no row
    has a value, 1 where all values are alike (to 9 digits); a missing value
    stays missing otherwise. One aggregation gives the bounds."""
    spans = df.groupBy(*by).agg(*[f(c).cast("double").alias(f"_{side}_{n}") for n, c in columns.items() for side, f in (("lo", F.min), ("hi", F.max))])

    def scaled(name: str, column: str) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        alike = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(lo), F.abs(hi))
        return F.when(lo.isNull(), 0.0).when(alike, 1.0).otherwise((F.col(column) - lo) / F.nullif(hi - lo, F.lit(0.0)))

    out = ranges.join_groups(df, spans, by)
    return out.withColumns({n: scaled(n, c) for n, c in columns.items()}).drop(*[c for c in spans.columns if c not in by])


def empirical_p(observed: Column, draw: Column) -> Column:
    """Aggregate: (1 + draws at or above the observed value) / (1 + draws)."""
    return (F.lit(1.0) + F.count_if(draw >= observed)) / (F.lit(1.0) + F.count(draw))
