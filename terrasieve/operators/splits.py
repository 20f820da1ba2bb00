"""Folds and samples, all deterministic."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settled
from . import guards, ranges


#: Groups that a split may have.
MOST_GROUPS = 1_000_000


def lightest_fold(sizes: Sequence[tuple[str, int]], k: int) -> dict[str, int]:
    """Groups, largest first and equal ones by name descending, go one by one
    to the lightest fold (ties to the first)."""
    load, out = [0] * k, {}
    for name, n in sorted(sizes, key=lambda x: (x[1], x[0]), reverse=True):
        f = load.index(min(load))
        out[name] = f
        load[f] += n
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """Add ``fold`` (from 0) so that no group is split and folds are even.
    Groups are a catalogue of ``MOST_GROUPS`` at most: one count each reaches
    the driver, more raise."""
    sizes = [(r[group], r["count"]) for r in df.groupBy(group).count().limit(MOST_GROUPS + 1).collect()]
    if len(sizes) > MOST_GROUPS:
        raise guards.ContractError(f"more than {MOST_GROUPS} groups")
    named = lightest_fold([(str(g), n) for g, n in sizes], k)
    table = df.sparkSession.createDataFrame([(g, named[str(g)]) for g, _ in sizes], f"_g {dict(df.dtypes)[group]}, {fold} int")
    return df.join(F.broadcast(table), df[group].eqNullSafe(table["_g"])).drop("_g")


def stratified_kfold(df: DataFrame, label: str, order: Sequence[Column | str], k: int = 5, fold: str = "fold") -> DataFrame:
    """Folds of even class counts: rows of a class are dealt in ``order``
    (a pseudo-random key; give a total order)."""
    return guards.number_within(df, [label], order, "_nth").withColumn(fold, (F.col("_nth") % k).cast("int")).drop("_nth")


def leave_one_group_out(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """One fold for each group, in order of name; rows without a group are
    in none."""
    names = guards.with_row_index(df.where(F.col(group).isNotNull()).select(group).distinct(), [group], fold)
    return df.join(names.withColumn(fold, F.col(fold).cast("int")), group)


def frozen_folds(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Folds of a published split; every row must find its one."""
    return guards.contract_join(df, table, keys, complete=True)


def usable_splits(df: DataFrame, label: str, most: int = 5) -> int:
    """min(most, positives, negatives); under 2 is an error."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    k = min(most, r["p"], r["n"])
    if k < 2:
        raise guards.ContractError("a class has fewer than two rows")
    return k


def train_test(df: DataFrame, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """All folds' training and test rows in one table: each row once for
    every fold, as ``test_fold`` and ``is_test``; one job fits all folds."""
    f = F.explode(F.array(*[F.lit(int(x)) for x in folds]))
    return df.withColumn("test_fold", f).withColumn("is_test", F.col("test_fold") == F.col(fold))


def stratified_half(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first half (rounded down) of each stratum in a pseudo-random order."""
    numbered = guards.number_within(df, by, order, "_nth")
    sizes = numbered.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.floor(F.count("*") / 2).alias("_half"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return numbered.join(sizes, same).where(F.col("_nth") < F.col("_half")).select(*df.columns)


def negative_schemes(positives: DataFrame, hard: DataFrame, background: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The schemes hard_only, background_only and mixed (half of each, by
    stratum), each with all positives, in one table by ``scheme``."""
    mixed = guards.union_all([stratified_half(hard, by, order), stratified_half(background, by, order)])
    parts = {"hard_only": hard, "background_only": background, "mixed": mixed}
    return guards.union_all([guards.union_all([positives, negatives]).withColumn("scheme", F.lit(name)) for name, negatives in parts.items()])


def matched_columns(catalog: DataFrame, selected: Sequence[str], order: Column, others_only: bool = False) -> DataFrame:
    """For the selected columns as many of all (or of the others only), without
    replacement, from the same quartile of missing rate: rows (column, quartile)."""
    q = catalog.agg(F.percentile("missing_rate", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q"))
    placed = catalog.crossJoin(F.broadcast(q)).withColumn("quartile", F.size(F.filter("q", lambda x: x < F.col("missing_rate"))))
    chosen = F.col("column").isin(list(selected))
    wanted = placed.where(chosen).groupBy("quartile").agg(F.count("*").alias("wanted"))
    pool = (placed.where(~chosen) if others_only else placed).withColumn("_nth", F.row_number().over(Window.partitionBy("quartile").orderBy(order, "column")))
    return pool.join(wanted, "quartile").where("_nth <= wanted").select("column", "quartile")


def draws(df: DataFrame, cluster: str, iterations: int, seed: int) -> DataFrame:
    """Clusters drawn with replacement: (iteration, cluster, times), as many
    draws an iteration as there are clusters, ``MOST_DRAWN`` at most."""
    names = sorted(r[cluster] for r in df.select(cluster).distinct().limit(MOST_DRAWN + 1).collect() if r[cluster] is not None)
    if len(names) > MOST_DRAWN:
        raise guards.ContractError(f"more than {MOST_DRAWN} clusters")
    times = drawn_times(len(names), iterations, seed)
    rows = [(int(i), names[j], int(times[i, j])) for i, j in zip(*np.nonzero(times))]
    return df.sparkSession.createDataFrame(rows, f"iteration int, {cluster} {dict(df.dtypes)[cluster]}, times int")


def drawn_times(n: int, iterations: int, seed: int) -> np.ndarray:
    """(iterations, n): how often each of n clusters is drawn in n draws."""
    rng = np.random.default_rng(seed)
    return np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(iterations)]) if n else np.zeros((iterations, 0), dtype=np.int64)


def matched_repeats(catalog: DataFrame, chosen: DataFrame, repeats: int, order: Column, others_only: bool = False) -> DataFrame:
    """``matched_columns`` for the chosen columns (fold, column) of all folds,
    ``repeats`` times each, in one window: (fold, repeat, column, quartile).
    ``order`` may use fold, repeat and the columns of the catalogue, which are
    a bounded table, as folds are."""
    q = catalog.agg(F.percentile("missing_rate", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("_q"))
    placed = catalog.crossJoin(F.broadcast(q)).withColumn("quartile", F.size(F.filter("_q", lambda x: x < F.col("missing_rate")))).drop("_q")
    taken = chosen.join(placed.select("column", "quartile"), "column")
    wanted = taken.groupBy("fold", "quartile").agg(F.count("*").alias("_wanted"))
    pool = placed.join(F.broadcast(wanted), "quartile").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    if others_only:
        pool = pool.join(F.broadcast(chosen), ["fold", "column"], "left_anti")
    place = F.row_number().over(Window.partitionBy("fold", "repeat", "quartile").orderBy("_order", "column"))
    return pool.withColumn("_order", order).withColumn("_nth", place).where("_nth <= _wanted").select("fold", "repeat", "column", "quartile")


def with_ratio(df: DataFrame, label: str, ratio: int, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """All positives, and of each stratum's negatives the first ``ratio`` for
    every positive of the stratum in a pseudo-random order (all, if fewer).

    Where the order begins with a number, only negatives up to a bound of it
    are numbered: the bound is a guess, and holds where enough rows are under
    it. ``df`` is read more than once."""
    positives, negatives = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    sizes = settled(positives.groupBy(*by).agg((F.count("*") * ratio).alias("_most")))
    first = F.col(order[0]) if isinstance(order[0], str) else order[0]
    if dict(negatives.select(first.alias("_o")).dtypes)["_o"] in ("int", "bigint", "double"):
        keyed = ranges.join_groups(negatives.withColumn("_o", first), sizes, by)
        # the least of 100 points of the key with enough rows under it, and some more
        points = F.percentile_approx("_o", F.array(*[F.lit(i / 100) for i in range(1, 100)]), F.lit(10_000))
        share = F.least(F.lit(100.0), F.ceil(F.max("_most") / F.count("*") * 100) + 2)
        bounds = settled(keyed.groupBy(*by).agg(F.max("_most").alias("_m"), F.get(points, (share - 1).cast("int")).alias("_bound")))
        under = F.count_if(F.col("_o").isNull() | (F.col("_o") <= F.col("_bound"))).alias("_under")
        held = settled(ranges.join_groups(keyed, bounds, by).groupBy(*by).agg(under, F.max("_m").alias("_m"), F.max("_bound").alias("_bound")))
        held = held.select(*by, F.when(F.col("_under") >= F.col("_m"), F.col("_bound")).alias("_bound"))
        few = ranges.join_groups(negatives.withColumn("_o", first), held, by)
        negatives = few.where(F.col("_bound").isNull() | F.col("_o").isNull() | (F.col("_o") <= F.col("_bound"))).select(*df.columns)
    numbered = ranges.join_groups(guards.number_within(negatives, by, order, "_nth"), sizes, by)
    return guards.union_all([positives, numbered.where(F.col("_nth") < F.col("_most")).select(*df.columns)])


#: Clusters whose draws reach the driver.
MOST_DRAWN = 100_000
#: Rows that a task shares draws out to, and parts that a group is cut in first.
ROWS_PER_PART, FIRST_PARTS = 2048, 256


def _shared_out(totals: np.ndarray, sizes: np.ndarray, seeds: Sequence[Any]) -> np.ndarray:
    """(iterations, parts): each iteration's draws shared out over parts of
    the given sizes, one binomial after another, by a seed of its own."""
    out = np.zeros((len(totals), len(sizes)), dtype=np.int64)
    for i, total in enumerate(totals):
        out[i] = np.random.default_rng([i, *seeds]).multinomial(int(total), sizes / sizes.sum())
    return out


def resampled(df: DataFrame, by: Sequence[str], key: Sequence[str], iterations: int = 100, seed: int = 0, times: str = "times") -> DataFrame:
    """``df`` with ``times``, an array of how often each row is drawn in each
    of ``iterations`` resamples of its group of ``by``: with replacement, and
    in all exactly as often as the group has rows.

    The draws of a group go down a tree: to parts by a hash of the row, to
    smaller parts of about ``ROWS_PER_PART`` rows, and to rows. Every share is
    a multinomial with a seed made of the place in the tree, so the same rows
    are drawn however the table is partitioned. ``key`` tells rows of a group
    apart; rows that are equal in all columns are dealt alike. Only counts of
    a group's first parts meet in one task."""
    mark = F.xxhash64(F.lit(seed), *key)
    digest = F.xxhash64(F.lit("group"), *by)
    held = settled(df)
    rows = held.withColumns({"_h": mark, "_g": digest})
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    # a bounded catalogue of groups tells how finely each is cut
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / (FIRST_PARTS * ROWS_PER_PART))).cast("long")
    cut = rows.join(F.broadcast(settled(sizes)), "_g").withColumns({"_first": F.pmod("_h", F.lit(FIRST_PARTS)).cast("int"), "_second": F.pmod(F.floor(F.col("_h") / FIRST_PARTS), parts)})
    counts = settled(cut.groupBy("_g", "_first", "_second").agg(F.count("*").alias("_m")))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_first")
        group, m = int(part["_g"].iloc[0]), part["_m"].to_numpy()
        got = _shared_out(np.full(iterations, m.sum()), m, [seed, group & 0xFFFFFFFF, (group >> 32) & 0xFFFFFFFF])
        return part[["_g", "_first"]].assign(_t=list(got.T))

    def second(key_: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(above):
            return pd.DataFrame({"_g": [], "_first": [], "_second": [], "_m": [], "_t": []})
        part = part.sort_values("_second")
        group = int(key_[0])
        got = _shared_out(np.asarray(above["_t"].iloc[0]), part["_m"].to_numpy(), [seed, group & 0xFFFFFFFF, (group >> 32) & 0xFFFFFFFF, int(key_[1])])
        return part[["_g", "_first", "_second", "_m"]].assign(_t=list(got.T))

    @F.pandas_udf("array<int>")
    def last(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        of, got = None, np.zeros((0, iterations), dtype=np.int32)
        for g, first_, second_, m, place, totals in batches:
            out = []
            for *key_, size, n, t in zip(g, first_, second_, m, place, totals):
                if key_ != of:  # the rows of a part follow each other
                    group, of = int(key_[0]), key_
                    got = _shared_out(np.asarray(t), np.ones(int(size)), [seed, group & 0xFFFFFFFF, (group >> 32) & 0xFFFFFFFF, int(key_[1]), int(key_[2]) + 1]).T.astype(np.int32)
                out.append(got[n - 1])
            yield pd.Series(out, dtype=object)

    one = counts.groupBy("_g", "_first").agg(F.sum("_m").alias("_m")).groupBy("_g").applyInPandas(first, "_g long, _first int, _t array<long>")
    keys = ["_g", "_first"]
    two = settled(counts.groupBy(*keys).cogroup(one.groupBy(*keys)).applyInPandas(second, "_g long, _first int, _second long, _m long, _t array<long>"))
    keys = [*keys, "_second"]
    # rows that are equal in all columns may change places
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", F.xxhash64(*df.columns)))
    met = cut.select(*df.columns, *keys, place.alias("_place")).join(two, keys)
    return met.select(*df.columns, last(*keys, "_m", "_place", "_t").alias(times))
