"""Statistics of the training rows of every fold, by subtraction.

A fold trains on all rows but its own. Counts of different values, missing
values and products are therefore summed once for each fold's own rows and
taken from the total: whatever the number of folds, a row is read once and
never copied. Counts by fold travel as one column for each fold; folds are a
catalogue of ``MOST_FOLDS`` at most.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import guards, ranges, spatial, stats

MOST_FOLDS = 256


def fold_names(df: DataFrame, fold: str) -> list[Any]:
    """The folds in order; rows without one are in every training set."""
    found = [r[fold] for r in df.select(fold).distinct().limit(MOST_FOLDS + 2).collect()]
    names = sorted(f for f in found if f is not None)
    if len(names) > MOST_FOLDS:
        raise guards.ContractError(f"more than {MOST_FOLDS} folds")
    return names


def _own_counts(fold: str, folds: Sequence[Any], weight: Column | None = None) -> list[Column]:
    """Aggregates: all rows as _all, and those of each fold as _own<i>."""
    one = F.lit(1) if weight is None else weight
    return [F.sum(one).cast("long").alias("_all"), *[F.sum(F.when(F.col(fold) == F.lit(f), one).otherwise(0)).cast("long").alias(f"_own{i}") for i, f in enumerate(folds)]]


def _below(folds: Sequence[Any]) -> dict[str, str]:
    return {"_below": "_all"} | {f"_below{i}": f"_own{i}" for i in range(len(folds))}


def medians(df: DataFrame, columns: Sequence[str], fold: str, folds: Sequence[Any], by: Sequence[str] = ()) -> dict[tuple, dict[str, float]]:
    """{(fold, *by): medians of its training rows}; a column without a value
    counts as 0. ``by`` is a bounded catalogue."""
    if not columns or not folds:
        return {}
    key = [*by, "concept"]
    long = stats.long_form(df, [fold, *by], columns).where("value is not null")
    cells = ranges.running_sums(long.groupBy(*key, "value").agg(*_own_counts(fold, folds)), key, ["value"], _below(folds))
    cells = ranges.join_groups(cells, stats.settled(cells.groupBy(*key).agg(*[F.sum(c).alias(c.replace("_", "_n_", 1)) for c in ("_all", *[f"_own{i}" for i in range(len(folds))])])), key)
    left = {f"_{what}_{i}": F.col(all_) - F.col(f"{own}{i}") for i in range(len(folds)) for what, all_, own in (("b", "_below", "_below"), ("c", "_all", "_own"), ("t", "_n_all", "_n_own"))}
    middle = [ranges.interpolated(f"_b_{i}", f"_c_{i}", "value", F.col(f"_t_{i}"), 0.5).alias(f"m{i}") for i in range(len(folds))]
    out: dict[tuple, dict[str, float]] = {}
    for r in cells.withColumns(left).groupBy(*key).agg(*middle).collect():
        for i, f in enumerate(folds):
            out.setdefault((f, *(r[c] for c in by)), dict.fromkeys(columns, 0.0))[r["concept"]] = float(r[f"m{i}"] or 0.0)
    return out


def grams(df: DataFrame, columns: Sequence[str], label: str | None, fold: str, folds: Sequence[Any], fills: dict[tuple, dict[str, float]], by: Sequence[str] = (), own: bool = False) -> dict[tuple, stats.Gram]:
    """{(fold, *by): ``Gram`` of its training rows, or of its ``own`` rows},
    nulls of ``columns`` filled from ``fills``; rows without ``label`` are left
    out.

    Values enter about one mean of all rows, with a column that tells where
    they are missing, so that any filling is a linear map of the products."""
    rows = df if label is None else df.where(F.col(label).isNotNull())
    names = [*columns, *([label] if label else [])]
    mean, gaps, values = _about_one_mean(rows, names)
    k, total = len(values), {}
    raw = {key: _raw(g) for key, g in stats.gram_by(rows, [*by, fold], values, [str(i) for i in range(k)]).items()}
    for (*group, _), part in raw.items():
        n, s, p = total.get(tuple(group), (0.0, np.zeros(k), np.zeros((k, k))))
        total[tuple(group)] = (n + part[0], s + part[1], p + part[2])
    out = {}
    for group, (n_all, s_all, p_all) in total.items():
        for f in folds:
            n0, s0, p0 = raw.get((*group, f), (0.0, np.zeros(k), np.zeros((k, k))))
            n, s, p = (n0, s0, p0) if own else (n_all - n0, s_all - s0, p_all - p0)
            if n > 0:
                out[(f, *group)] = _filled(names, n, s, p, mean, gaps, fills.get((f, *group), {}))
    return out


def _about_one_mean(rows: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, list[int], list[Column]]:
    """The means of the columns, those with gaps, and the values of a row:
    differences from the means (0 in gaps) and whether each gap is one."""
    first = rows.agg(*[a for i, c in enumerate(names) for a in (F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"))]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(len(names))])
    gaps = [i for i in range(len(names)) if first[f"z{i}"]]
    values = [F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(names, mean)] + [F.col(names[i]).isNull().cast("double") for i in gaps]
    return mean, gaps, values


def _raw(g: stats.Gram) -> tuple[float, np.ndarray, np.ndarray]:
    return g.n, g.n * g.mean, g.n * (g.cov + np.outer(g.mean, g.mean))


def _filled(names: Sequence[str], n: float, s: np.ndarray, p: np.ndarray, mean: np.ndarray, gaps: Sequence[int], fill: Mapping[str, float]) -> stats.Gram:
    made = np.zeros((len(s), len(names)))
    made[: len(names), : len(names)] = np.eye(len(names))
    for j, i in enumerate(gaps):
        made[len(names) + j, i] = fill.get(names[i], 0.0) - mean[i]
    at = made.T @ s / n
    return stats.Gram(list(names), n, mean + at, made.T @ p @ made / n - np.outer(at, at))


def buffered(df: DataFrame, fold: str, folds: Sequence[Any], key: str, radii: Sequence[float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with ``_out``, the parts that a row belongs to: part i * (n + 1)
    is fold i itself, and part i * (n + 1) + j the rows of other folds whose
    nearest row of fold i is within the j-th of the n growing ``radii``, but
    not within the one before. ``key`` tells rows apart."""
    n = len(radii)
    points = df.select(fold, key, lat, lon)
    near = spatial.nearest(points, points, key, key, lat, lon, fold=fold, each_fold=True, within_km=max(radii), by_place=True)
    band = F.lit(1)
    for r in radii[:-1]:
        band = band + (F.col("km_apart") > r).cast("int")
    at = lambda c: F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(c)).cast("int") - 1
    met = spatial.with_near_folds(df, near, at(f"r_{fold}") * (n + 1) + band, lat, lon)
    # a row's own fold is near it, but not another; rows without a fold are in no fold's buffer, as they were
    others = F.filter(F.coalesce("_near", F.array().cast("array<int>")), lambda i: F.floor(i / (n + 1)) != at(fold))
    parts = F.concat(F.array(at(fold) * (n + 1)), others)
    return met.withColumn("_out", F.when(F.col(fold).isNull(), F.array().cast("array<int>")).otherwise(parts)).drop("_near")


def buffered_sets(folds: Sequence[Any], radii: Sequence[float]) -> dict[tuple, list[int]]:
    """{(fold, radius): the parts of ``buffered`` that its training rows are
    not in}, with a radius of 0 for no buffer."""
    n = len(radii)
    return {(f, float(r)): list(range(i * (n + 1), i * (n + 1) + j + 1)) for i, f in enumerate(folds) for j, r in enumerate((0.0, *radii))}


def medians_of_sets(df: DataFrame, columns: Sequence[str], sets: Mapping[tuple, Sequence[int]]) -> dict[tuple, dict[str, float]]:
    """{set: medians of the rows that are in none of its parts}, by counts of
    different values in all rows and in each part (``_out`` of a row)."""
    ids = sorted({i for parts in sets.values() for i in parts})
    long = stats.long_form(df, ["_out"], columns).where("value is not null")
    counts = [F.count("*").alias("_all"), *[F.count_if(F.array_contains("_out", F.lit(i))).alias(f"_own{i}") for i in ids]]
    names = ["_all", *[f"_own{i}" for i in ids]]
    cells = ranges.running_sums(long.groupBy("concept", "value").agg(*counts), ["concept"], ["value"], {n.replace("_", "_b", 1): n for n in names})
    cells = ranges.join_groups(cells, stats.settled(cells.groupBy("concept").agg(*[F.sum(n).alias(n.replace("_", "_n", 1)) for n in names])), ["concept"])
    left, named = {}, list(sets)
    for x, name in enumerate(named):
        for what in ("b", "", "n"):
            value = F.col(f"_{what}all")
            for i in sets[name]:
                value = value - F.col(f"_{what}own{i}")
            left[f"_s{what}_{x}"] = value
    middle = [ranges.interpolated(f"_sb_{x}", f"_s_{x}", "value", F.col(f"_sn_{x}"), 0.5).alias(f"m{x}") for x in range(len(named))]
    out: dict[tuple, dict[str, float]] = {name: dict.fromkeys(columns, 0.0) for name in named}
    for r in cells.withColumns(left).groupBy("concept").agg(*middle).collect():
        for x, name in enumerate(named):
            out[name][r["concept"]] = float(r[f"m{x}"] or 0.0)
    return out


def grams_of_sets(df: DataFrame, columns: Sequence[str], label: str, sets: Mapping[tuple, Sequence[int]], fills: Mapping[tuple, dict[str, float]]) -> dict[tuple, stats.Gram]:
    """{set: ``Gram`` of the rows that are in none of its parts}: the products
    of all rows less those of the parts, each part's own rows read once."""
    rows, names = df.where(F.col(label).isNotNull()), [*columns, label]
    mean, gaps, values = _about_one_mean(rows, names)
    k = len(values)
    whole = stats.gram(rows, values, [str(i) for i in range(k)])
    parts = stats.gram_by(rows.withColumn("_part", F.explode("_out")), ["_part"], values, whole.names)
    raw = {key: _raw(g) for (key,), g in parts.items()}
    out = {}
    for name, excluded in sets.items():
        n, s, p = _raw(whole)
        for i in excluded:
            if i in raw:
                n, s, p = n - raw[i][0], s - raw[i][1], p - raw[i][2]
        if n > 0:
            out[name] = _filled(names, n, s, p, mean, gaps, fills.get(name, {}))
    return out


def spearman_pairs(df: DataFrame, targets: Sequence[str], covariates: Sequence[str], fold: str, folds: Sequence[Any], min_pairs: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlations among the training rows of every fold that have both
    values: (test_fold, *by, target, covariate, n_pairs, spearman), null under
    ``min_pairs`` pairs or for a constant side.

    The rank of a value among training rows is its rank among all rows less
    that among the fold's own; each different value carries both for every
    fold, and pairs of values are counted before they meet their ranks."""
    if not folds:
        types = {"target": "string", "covariate": "string", "n_pairs": "long", "spearman": "double"}
        return df.limit(0).select(F.col(fold).alias("test_fold"), *by, *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    met, rest = stats.narrow_sides(df, [(t, c) for t in targets for c in covariates if t != c])
    parts = ([_pairs_narrow(df, met, fold, folds, min_pairs, by)] if met else []) + ([_pairs_wide(df, rest, fold, folds, min_pairs, by)] if rest else [])
    return guards.union_all(parts)


def _correlated(joined: DataFrame, named: Sequence[Column | str], folds: Sequence[Any], min_pairs: int) -> DataFrame:
    """Correlations of all folds from the sums of centred ranks in ``joined``:
    s_a, s_b (squares) and s_ab (products), by fold."""
    n = lambda i: F.col("_n_all") - F.col(f"_n_own{i}")
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("test_fold"), n(i).alias("n_pairs"), F.get("s_a", F.lit(i)).alias("sa"), F.get("s_b", F.lit(i)).alias("sb"), F.get("s_ab", F.lit(i)).alias("sab")) for i, f in enumerate(folds)]))
    fine = (F.col("n_pairs") >= min_pairs) & (F.col("sa") > stats.TINY) & (F.col("sb") > stats.TINY)
    out = joined.select(*named, rows).where("n_pairs > 0")
    return out.select("test_fold", *[c for c in out.columns if c not in ("test_fold", "n_pairs", "sa", "sb", "sab")], "n_pairs", F.when(fine, F.col("sab") / F.sqrt(F.col("sa") * F.col("sb"))).alias("spearman"))


def _pairs_narrow(df: DataFrame, met: Sequence[tuple[str, str, bool]], fold: str, folds: Sequence[Any], min_pairs: int, by: Sequence[str]) -> DataFrame:
    """Pairs with a narrow column, whose ranks are sent to the rows: these meet
    by values of the other column alone, with a count and a sum for each fold."""
    long, key, own = stats.numbered_pairs(df, [fold, *by], met), [*by, "_pair"], ["_all", *[f"_own{i}" for i in range(len(folds))]]
    each = lambda f: F.array(*[f(i) for i in range(len(folds))])
    held = lambda i: F.col("_all") - F.col(f"_own{i}")
    # the middle rank of a value among a fold's training rows, less the middle of all ranks
    place = lambda i: F.col("_below") - F.col(f"_below{i}") + (held(i) - F.col("_n_all") + F.col(f"_n_own{i}")) / 2
    counts = stats.settled(long.groupBy(*key, "b").agg(*_own_counts(fold, folds)))
    totals = stats.settled(counts.groupBy(*key).agg(*[F.sum(c).alias(c.replace("_", "_n_", 1)) for c in own]))
    ranked = lambda d, side: ranges.join_groups(ranges.running_sums(d, key, [side], _below(folds)), totals, key)
    narrow = stats.settled(ranked(counts, "b").select(*key, "b", each(held).alias("_held"), each(place).alias("_y")))
    s_b = narrow.groupBy(*key).agg(each(lambda i: F.sum(F.get("_held", F.lit(i)) * F.pow(F.get("_y", F.lit(i)), 2))).alias("s_b"))
    rows = ranges.join_groups(long, narrow.select(*key, "b", "_y"), [*key, "b"])
    trains = lambda f: F.coalesce(F.col(fold) != F.lit(f), F.lit(True))
    sums = [F.sum(F.when(trains(f), F.get("_y", F.lit(i))).otherwise(0.0)).alias(f"_sy{i}") for i, f in enumerate(folds)]
    wide = ranked(rows.groupBy(*key, "a").agg(*_own_counts(fold, folds), *sums), "a")
    s_a = wide.groupBy(*key).agg(each(lambda i: F.sum(held(i) * F.pow(place(i), 2))).alias("s_a"), each(lambda i: F.sum(place(i) * F.col(f"_sy{i}"))).alias("s_ab"))
    joined = ranges.join_groups(ranges.join_groups(totals, s_a, key), s_b, key)
    return _correlated(joined, [*by, *stats.pair_names(met)], folds, min_pairs)


def _pairs_wide(df: DataFrame, wanted: Sequence[tuple[str, str]], fold: str, folds: Sequence[Any], min_pairs: int, by: Sequence[str]) -> DataFrame:
    """Pairs of two columns of many values: by counts of pairs of values."""
    pairs = [F.struct(F.lit(t).alias("target"), F.lit(c).alias("covariate"), F.col(t).cast("double").alias("a"), F.col(c).cast("double").alias("b")) for t, c in wanted]
    long = df.select(fold, *by, F.inline(F.array(*pairs))).where("a is not null and b is not null")
    key, own = [*by, "target", "covariate"], ["_all", *[f"_own{i}" for i in range(len(folds))]]
    cells = stats.settled(long.groupBy(*key, "a", "b").agg(*_own_counts(fold, folds)))
    totals = stats.settled(cells.groupBy(*key).agg(*[F.sum(c).alias(c.replace("_", "_n_", 1)) for c in own]))
    each = lambda f: F.array(*[f(i) for i in range(len(folds))])

    def ranked(side: str) -> DataFrame:
        counts = cells.groupBy(*key, side).agg(*[F.sum(c).alias(c) for c in own], F.count("*").alias("_cells"))
        run = ranges.join_groups(ranges.running_sums(counts, key, [side], _below(folds)), totals, key)
        held = lambda i: F.col("_all") - F.col(f"_own{i}")
        # the middle rank of the value, less the middle of all ranks
        x = each(lambda i: F.col("_below") - F.col(f"_below{i}") + (held(i) - F.col("_n_all") + F.col(f"_n_own{i}")) / 2)
        return run.select(*key, side, "_cells", x.alias(f"x_{side}"), each(held).alias("_held"))

    sides = {s: stats.settled(ranked(s)) for s in "ab"}
    spread = {s: d.groupBy(*key).agg(F.array(*[F.sum(F.get("_held", F.lit(i)) * F.pow(F.get(f"x_{s}", F.lit(i)), 2)) for i in range(len(folds))]).alias(f"s_{s}")) for s, d in sides.items()}
    n_cells = max(1, cells.count())
    met = cells
    for s, d in sides.items():
        met = ranges.join_by_class(met, d.drop("_held"), [*key, s], "_cells", n_cells)
    both = met.groupBy(*key).agg(F.array(*[F.sum((F.col("_all") - F.col(f"_own{i}")) * F.get("x_a", F.lit(i)) * F.get("x_b", F.lit(i))) for i in range(len(folds))]).alias("s_ab"))
    joined = totals
    for part in (spread["a"], spread["b"], both):
        joined = ranges.join_groups(joined, part, key)
    return _correlated(joined, key, folds, min_pairs)


def spearman_wide(df: DataFrame, pairs: Sequence[tuple[str, str]], fold: str, folds: Sequence[Any], min_pairs: int = 30) -> DataFrame:
    """``spearman_pairs`` of many columns that lack no value: each column is
    ranked once, and the products of all centred ranks are summed in blocks of
    rows for every fold."""
    names = sorted({c for p in pairs for c in p})
    held = stats.settled(df.select(F.col(fold).alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names], F.monotonically_increasing_id().alias("_id")))
    long = stats.long_form(held, ["_id", "_fold"], names)
    counts = long.groupBy("concept", "value").agg(*_own_counts("_fold", folds))
    run = ranges.running_sums(counts, ["concept"], ["value"], _below(folds))
    n_all, n_own = held.count(), {r["_fold"]: r["count"] for r in held.groupBy("_fold").count().collect()}
    left = [n_all - n_own.get(f, 0) for f in folds]
    x = F.array(*[F.col("_below") - F.col(f"_below{i}") + (F.col("_all") - F.col(f"_own{i}") - F.lit(n)) / 2 for i, n in enumerate(left)])
    at = (F.array_position(F.array(*[F.lit(c) for c in names]), F.col("concept")) - 1).cast("int")
    ranks = run.select("concept", "value", F.col("_all").alias("_m"), x.alias("_x"))
    met = ranges.join_by_class(long, ranks, ["concept", "value"], "_m", max(1, n_all * len(names)))
    rows = met.groupBy("_id", "_fold").agg(F.sort_array(F.collect_list(F.struct(at.alias("i"), F.col("_x").alias("x")))).alias("_v")).select("_fold", F.flatten("_v.x").alias("_x"))
    k, n_folds = len(names), len(folds)
    own = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("_fold"))
    sums = stats.fold_products(rows.select(F.coalesce(own - 1, F.lit(-1)).cast("int").alias("_own"), "_x"), k, n_folds)
    index, out = {c: i for i, c in enumerate(names)}, []
    for f, n, s in zip(folds, left, sums):
        for a, b in pairs:
            i, j = index[a], index[b]
            fine = n >= min_pairs and s[i, i] > stats.TINY and s[j, j] > stats.TINY
            if n:
                out.append((f, a, b, int(n), float(s[i, j] / math.sqrt(s[i, i] * s[j, j])) if fine else None))
    return df.sparkSession.createDataFrame(out, f"test_fold {dict(df.dtypes)[fold]}, target string, covariate string, n_pairs long, spearman double")


def spearman(df: DataFrame, targets: Sequence[str], covariates: Sequence[str], fold: str, folds: Sequence[Any], min_pairs: int = 30) -> DataFrame:
    """``spearman_pairs`` of a few pairs; of many, columns without gaps share
    one ranking of each."""
    pairs = [(t, c) for t in targets for c in covariates if t != c]
    if len(pairs) <= stats.MOST_PAIRS:
        return spearman_pairs(df, targets, covariates, fold, folds, min_pairs)
    names = sorted({c for p in pairs for c in p})
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    full = [p for p in pairs if not gaps[p[0]] and not gaps[p[1]]]
    parts = [spearman_wide(df, full, fold, folds, min_pairs)] if full else []
    # what is left, a band of targets at a time, so that a row is not written out for all pairs at once
    rest: dict[tuple[str, ...], list[str]] = {}
    for t in targets:
        if others := tuple(c for c in covariates if t != c and (t, c) not in set(full)):
            rest.setdefault(others, []).append(t)
    for others, ts in rest.items():
        step = max(1, stats.MOST_PAIRS // len(others))
        parts += [spearman_pairs(df, ts[i : i + step], others, fold, folds, min_pairs) for i in range(0, len(ts), step)]
    return guards.union_all(parts)


def effects(df: DataFrame, env: str, label: str, columns: Sequence[str], fold: str, folds: Sequence[Any]) -> DataFrame:
    """Effects of each column in each environment among the training rows of
    every fold: (test_fold, env, concept, n_positive, n_negative,
    mean_difference, auc, auc_strength, direction). One table of counts of
    different values by class and fold gives them all."""
    names = ["_all", *[f"_own{i}" for i in range(len(folds))]]
    rows = df.where(F.col(label).isNotNull()).select(F.col(env).alias("env"), F.col(label).alias("_y"), F.col(fold).alias("_fold"), *columns)
    long = stats.long_form(rows, ["env", "_y", "_fold"], columns).where("value is not null")
    key, of = ["env", "concept"], {"p": F.when(F.col("_y") == 1, 1).otherwise(0), "n": F.when(F.col("_y") == 1, 0).otherwise(1)}
    counts = long.groupBy(*key, "value").agg(*[a.alias(f"{side}{n}") for side, one in of.items() for a, n in zip(_own_counts("_fold", folds, one), names)])
    cells = ranges.running_sums(counts, key, ["value"], {f"b{n}": f"n{n}" for n in names})
    each = []
    for i in range(len(folds)):
        p, n, b = (F.col(f"{x}_all") - F.col(f"{x}_own{i}") for x in "pnb")
        each.append(F.struct(F.sum(p).alias("p"), F.sum(n).alias("n"), F.sum(p * (b + n / 2)).alias("won"), F.sum(p * F.col("value")).alias("sp"), F.sum(n * F.col("value")).alias("sn")).alias(f"f{i}"))
    wide = cells.groupBy(*key).agg(*each)
    out = wide.select(*key, F.inline(F.array(*[F.struct(F.lit(f).alias("test_fold"), *[F.col(f"f{i}")[x].alias(x) for x in ("p", "n", "won", "sp", "sn")]) for i, f in enumerate(folds)])))
    auc = F.try_divide(F.col("won"), F.col("p") * F.col("n"))
    diff = F.try_divide("sp", "p") - F.try_divide("sn", "n")
    return out.where("p + n > 0").select(
        "test_fold", *key, F.col("p").alias("n_positive"), F.col("n").alias("n_negative"), diff.alias("mean_difference"), auc.alias("auc"), (2 * F.abs(auc - 0.5)).alias("auc_strength"),
        F.when(diff > 0, "positive_higher").otherwise("negative_higher").alias("direction"),
    )
