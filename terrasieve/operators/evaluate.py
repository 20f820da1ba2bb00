"""Evaluation of out-of-fold predictions (y, p in long tables)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settled
from . import guards, ranges, stats

FRACTIONS = (0.01, 0.05, 0.10, 0.20)
TOP_METRICS = ("precision", "recall", "f1", "lift", "ndcg")


def classification_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", weight: str | None = None, most: int | None = None) -> DataFrame:
    """ROC-AUC and average precision (null for one class), balanced accuracy,
    precision, recall and F1 at 0.5, and the confusion counts, for each group.

    Rows of a group with equal scores are counted by class first and share a
    threshold; counts above each score are summed by ranges, so no task sorts
    a group. ``weight`` counts a row so many times, as bootstraps need.
    ``most``, where it is known, bounds the rows of ``df``, which then meet in
    their ranges; no score should be that of a large part of the rows."""
    one = F.col(weight) if weight else F.lit(1)
    counted = lambda d: d.groupBy(*by, p).agg(F.sum(F.when(F.col(y) == 1, one).otherwise(0)).cast("long").alias("_p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(one)).cast("long").alias("_n"))
    cells = ranges.running_sums(df, by, [F.desc(p)], {"_tp": "_p", "_fp": "_n"}, most=most, merged=counted)
    cells = cells.withColumns({"_tp": F.col("_tp") + F.col("_p"), "_fp": F.col("_fp") + F.col("_n")})
    hit = F.col(p) >= 0.5
    out = cells.groupBy(*by).agg(
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"),
        F.sum(F.col("_n") * (F.col("_tp") - F.col("_p") / 2)).alias("_won"),
        F.sum(F.col("_p") * F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp"))).alias("_ap"),
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("fp"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        *by, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
        F.when(both, F.try_divide(F.col("_won"), F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_ap"), F.col("n_pos"))).alias("average_precision"),
        F.when(both, (F.try_divide(tp, F.col("n_pos")) + F.try_divide(tn, F.col("n_neg"))) / 2).alias("balanced_accuracy"),
        zero(tp, tp + fp).alias("precision"), zero(tp, F.col("n_pos")).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        tn.cast("long").alias("tn"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), tp.cast("long").alias("tp"),
    )


def top_size(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(fraction))))


def top_metrics(df: DataFrame, by: Sequence[str], order: str = "row_index", y: str = "y", p: str = "p", fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Precision, recall, F1, lift and NDCG in the top fractions of each
    group, by score descending and ``order`` ascending: long rows
    (by, fraction, k, hits, ...). Lift is null for a base rate of 0, NDCG for
    an ideal of 0."""
    rows = df.select(*by, F.col(y).cast("int").alias("y"), F.col(p).alias("_p"), F.col(order).alias("_o"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))
    ranked = ranges.join_groups(guards.number_within(rows, by, [F.desc("_p"), "_o"], "rn"), totals, by).withColumn("rn", F.col("rn") + 1)
    ranked = ranked.where(F.col("rn") <= top_size(F.col("n"), max(fractions)))
    long = ranked.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("fraction"))).cast("long"))
    gain = 1 / F.log2(F.col("rn") + 1)
    sums = long.where("rn <= k").groupBy(*by, "fraction", "k", "n", "n_pos").agg(
        F.sum("y").alias("hits"), F.sum(F.col("y") * gain).alias("dcg"), F.sum(F.when(F.col("rn") <= F.col("n_pos"), gain).otherwise(0.0)).alias("ideal")
    )
    precision, recall = F.col("hits") / F.col("k"), F.col("hits") / F.greatest(F.col("n_pos"), F.lit(1))
    return sums.select(
        *by, "fraction", "k", "hits", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        F.try_divide(precision, F.col("n_pos") / F.col("n")).alias("lift"), F.when(F.col("ideal") > 0, F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0))).alias("ndcg"),
    )


def top_wide(top: DataFrame, by: Sequence[str], fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """``top_metrics`` with one column for each metric: top05_f1 and so on."""
    pick = lambda f, m: F.max(F.when(F.abs(F.col("fraction") - f) < 1e-9, F.col(m)))
    return top.groupBy(*by).agg(*[pick(f, m).alias(f"top{round(f * 100):02d}_{m}") for f in fractions for m in TOP_METRICS])


def summarize(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count of each metric; null groups stay."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_count"))]
    return metrics.groupBy(*by).agg(*aggs)


def paired_contrast(metrics: DataFrame, keys: Sequence[str], model: str, baseline: str, candidate: str, columns: Sequence[str], tie: float = 1e-12) -> DataFrame:
    """candidate - baseline over folds for each metric: mean difference and
    folds better, equal (within ``tie``) and worse. A fold without its pair
    raises."""
    picked = metrics.where(F.col(model).isin(baseline, candidate))
    of = lambda name, c: F.max(F.when(F.col(model) == name, F.col(c)))
    wide = picked.groupBy(*keys).agg(
        F.count_distinct(model).alias("_models"), *[x for c in columns for x in (of(baseline, c).alias(f"b_{c}"), of(candidate, c).alias(f"c_{c}"))]
    )
    checked = wide.where(F.coalesce(F.assert_true(F.col("_models") == 2, F.lit("a fold lacks its pair")).isNull(), F.lit(True)))
    long = checked.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(f"c_{c}") - F.col(f"b_{c}")).alias("delta")) for c in columns])))
    d = F.col("delta")
    return long.groupBy("metric").agg(
        F.count("delta").alias("n_folds"), F.avg("delta").alias("mean_delta"), F.count_if(d > tie).alias("better"), F.count_if(F.abs(d) <= tie).alias("equal"), F.count_if(d < -tie).alias("worse")
    )


def cluster_bootstrap(scores: DataFrame, times: DataFrame, cluster: str, models: Sequence[str]) -> DataFrame:
    """Metrics of each model in each resample of clusters.

    ``scores`` is long (model, cluster, y, p); ``times`` (iteration, cluster,
    times) is small. Rows are weighted by times, never repeated; scores of
    equal value and class meet before they are multiplied out."""
    cells = scores.where(F.col("model").isin(list(models))).groupBy("model", cluster, "y", "p").agg(F.count("*").alias("c"))
    drawn = cells.join(times, cluster).withColumn("w", F.col("c") * F.col("times"))
    return classification_metrics(drawn, ["iteration", "model"], weight="w")


#: Discounts of ranks that are held one by one; later ones are integrated.
_HELD = 2**20
#: What ``bootstrap_draws`` gives of each draw.
DRAW_METRICS = ("roc_auc", "average_precision", "f1", "top05_f1", "top05_ndcg", "top10_f1", "top10_ndcg")


def _discounts(upto: int) -> np.ndarray:
    """Sums of 1 / log2(rank + 1) over the first 0, 1, ... ranks."""
    return np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, min(upto, _HELD) + 2)))])


def _discount(table: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The sum over the first ranks; past the table an integral of the rest."""
    ranks = np.asarray(ranks)
    out = table[np.minimum(ranks, len(table) - 1)]
    far = np.flatnonzero(ranks.ravel() > len(table) - 1)
    if len(far):
        x = np.geomspace(len(table) - 0.5, float(ranks.max()) + 0.5, 20_001)
        y = 1 / np.log2(x + 1)
        area = np.concatenate([[0.0], np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(x))])
        out.ravel()[far] += np.interp(ranks.ravel()[far] + 0.5, x, area)
    return out


#: A block of rows whose ranks span up to this part of themselves takes its
#: discounts from one line; the second-order rest is under 2e-7 of them.
_REACH = 4e-3


def _top_sums(y: np.ndarray, at: np.ndarray, w: np.ndarray, above: np.ndarray, tops: np.ndarray, table: np.ndarray, block: int) -> np.ndarray:
    """Hits and discounted hits (a pair of lines for each line of ``tops``)
    that rows in order add to every draw, which has ``above`` rows before them
    and takes the first ``tops`` rows.

    Where ranks are large, a block of rows counts as a whole: positives by
    cluster give the hits, and pairs of a positive row and one before it, by
    their clusters, the ranks of the positives. Only first ranks and the draws
    whose top ends in the block go row by row."""
    above, most, heavy, k = above.astype(float), tops.max(axis=0), max(1.0, float(w.max(initial=1.0))), w.shape[1]
    out = np.zeros((2 * len(tops), len(w)))

    def by_row(draws: np.ndarray, x: int, a: int, b: int) -> None:
        weight, hit = w[np.ix_(draws, at[a:b])], y[a:b]
        begin = (np.cumsum(weight, axis=1) - weight)[:, hit] + above[draws][:, None]
        end = tops[x][draws][:, None]
        taken = np.clip(end - begin, 0, weight[:, hit])
        first = np.minimum(begin, end)
        out[2 * x, draws] += taken.sum(axis=1)
        held = np.minimum(first, len(table) - 1).astype(np.int64)
        sums = table[np.minimum(held + taken.astype(np.int64), len(table) - 1)] - table[held]
        far = first + taken > len(table) - 1
        if far.any():
            sums[far] = taken[far] / np.log2(first[far] + (taken[far] - 1) / 2 + 2)
        out[2 * x + 1, draws] += sums.sum(axis=1)

    a = 0
    while a < len(y):
        live = np.flatnonzero(above < most)
        if not len(live):
            break
        near = int(above[live].min() * _REACH / heavy)
        whole = near >= 16
        b = min(a + (min(near, 4096) if whole else block), len(y))
        own, begin = w[live], above[live]
        size = own @ np.bincount(at[a:b], minlength=k)
        if whole:
            one = np.zeros((b - a, k))
            one[np.arange(b - a), at[a:b]] = 1
            hit = y[a:b]
            positives = one[hit].sum(axis=0)
            before = one[hit].T @ (np.cumsum(one, axis=0) - one)[hit]
            hits = own @ positives
            places = ((own @ before) * own).sum(axis=1) + (own * (own - 1) / 2) @ positives
            middle = (size - 1) / 2
            ln = np.log(begin + middle + 2)
            gain = np.log(2) / ln * (hits - (places - hits * middle) / ((begin + middle + 2) * ln))
        for x in range(len(tops)):
            end = tops[x][live]
            part = begin < end
            if whole:
                inside = begin + size <= end
                out[2 * x, live] += np.where(inside, hits, 0)
                out[2 * x + 1, live] += np.where(inside, gain, 0)
                part &= ~inside
            if part.any():
                by_row(live[part], x, a, b)
        above[live] += size
        a = b
    return out


def _by_ranges(rows: DataFrame, order: Sequence[Column | str], cluster: str, place: dict, sums: Sequence[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, rows_per_range: int) -> DataFrame:
    """``work`` on each range of a model's rows in ``order``, with the sums of
    each cluster over the ranges before it, (clusters, sums)."""
    ranges_ = max(1, math.ceil(rows.count() / rows_per_range))
    dealt = settled(rows.repartitionByRange(ranges_, "model", *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("model", cluster).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("model", "_range", cluster).agg(*[F.sum(c).alias(c) for c in sums])
    reached = dealt.select("model", "_range").distinct()  # a row for each range and model
    grid = reached.join(dealt.select("model", cluster).distinct(), "model").join(totals, ["model", "_range", cluster], "left")
    carried = settled(grid.select("model", "_range", cluster, *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0)).alias(c) for c in sums]))

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        carry = np.zeros((len(place), len(sums)))
        carry[above[cluster].map(place).to_numpy()] = above[list(sums)].to_numpy(float)
        return work(part, carry)

    keys, tasks = ["model", "_range"], 2 * ranges_ + 2  # named, as ranges are few bytes for much work and would be put into few tasks
    return dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(carried.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, schema)


def bootstrap_draws(scores: DataFrame, cluster: str, times: np.ndarray, clusters: Sequence, order: str = "row_index", rows_per_range: int = 200_000, block: int = 1024, names: Sequence[str] = DRAW_METRICS) -> DataFrame:
    """(iteration, model, ``names`` of ``DRAW_METRICS``) of every model of
    ``scores`` (model, cluster, y, p, ``order``) in each resample of clusters;
    ``times`` (iterations, clusters) says how often each is drawn, as
    ``splits.drawn_times`` gives it.

    Equal scores of a cluster meet first. They are dealt into ranges; a task
    takes its own block by block, as a product of draws and clusters, and
    starts from the sums of the ranges before. Top shares need single rows, in
    order, but only those of scores that the top of some draw reaches. A row
    is met once for all draws and never repeated; a model and draw without
    both classes has null for the first two."""
    place, w = {c: i for i, c in enumerate(clusters)}, np.asarray(times, dtype=np.float64)
    draws = len(w)
    rows = scores.where(F.col("y").isNotNull() & F.col("p").isNotNull() & F.col(cluster).isin(list(clusters))).select("model", cluster, F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p"), F.col(order).alias("_o"))
    cells = settled(rows.groupBy("model", cluster, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    sizes = cells.groupBy("model", cluster).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("pos")).collect()  # models x clusters
    totals: dict[str, np.ndarray] = {}
    for r in sizes:
        totals[r["model"]] = totals.get(r["model"], np.zeros((draws, 2))) + np.outer(w[:, place[r[cluster]]], [r["n"], r["pos"]])
    shares = (0.05, 0.10)
    size = {m: np.stack([np.maximum(1, np.ceil(t[:, 0] * f)) for f in shares]) for m, t in totals.items()}

    def ranked(part: pd.DataFrame, carry: np.ndarray) -> pd.DataFrame:
        part = part.sort_values("p", ascending=False, kind="stable")
        p, pos, neg, at = part["p"].to_numpy(), part["pos"].to_numpy(float), part["neg"].to_numpy(float), part[cluster].map(place).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        above, out = w @ carry, np.zeros((4, draws))  # (draws, pos and neg)
        model = part["model"].iloc[0]
        most, floor = size[model].max(axis=0), []
        i = 0
        while i < len(starts):
            j = int(max(np.searchsorted(starts, starts[i] + block, side="left"), i + 1))
            a, b = starts[i], starts[j] if j < len(starts) else len(p)
            weight, first = w[:, at[a:b]], starts[i:j] - a
            dp, dn = np.add.reduceat(weight * pos[a:b], first, axis=1), np.add.reduceat(weight * neg[a:b], first, axis=1)
            tp, fp = np.cumsum(dp, axis=1) + above[:, :1], np.cumsum(dn, axis=1) + above[:, 1:]
            out[0] += (dn * (tp - dp / 2)).sum(axis=1)
            out[1] += np.where(dp > 0, dp * tp / np.maximum(tp + fp, 1), 0).sum(axis=1)
            hit = p[starts[i:j]] >= 0.5
            out[2] += dp[:, hit].sum(axis=1)
            out[3] += dn[:, hit].sum(axis=1)
            if not (above.sum(axis=1) >= most).all() and (full := (tp + fp >= most[:, None]).all(axis=0)).any():
                floor = [np.array([p[starts[i + int(full.argmax())]]])]  # the top of no draw goes below this score
            above, i = np.stack([tp[:, -1], fp[:, -1]], axis=1), j
        return pd.DataFrame({"model": model, "part": ["won", "ap", "tp", "fp", "floor"][: 4 + len(floor)], "v": [*out, *floor]})

    def summed(sums: DataFrame) -> dict[tuple[str, str], np.ndarray]:
        added = sums.select("model", "part", array_to_vector("v").alias("v")).groupBy("model", "part").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
        return {(r["model"], r["part"]): np.array(r["v"]) for r in added.collect()}  # a few rows of numbers for each model

    schema = "model string, part string, v array<double>"
    found = summed(_by_ranges(cells, [F.desc("p")], cluster, place, ["pos", "neg"], ranked, schema, rows_per_range))
    table = _discounts(int(max((k.max() for k in size.values()), default=1)))

    def topped(part: pd.DataFrame, carry: np.ndarray) -> pd.DataFrame:
        part = part.sort_values(["p", "_o", "y", cluster], ascending=[False, True, True, True], kind="stable")
        model, y, at = part["model"].iloc[0], part["y"].to_numpy() == 1, part[cluster].map(place).to_numpy()
        return pd.DataFrame({"model": model, "part": ["hits05", "dcg05", "hits10", "dcg10"], "v": list(_top_sums(y, at, w, w @ carry[:, 0], size[model], table, block))})

    if totals and any(n.startswith("top") for n in names):
        floors = F.create_map(*[F.lit(x) for m in totals for x in (m, float(found[m, "floor"][0]) if (m, "floor") in found else float("-inf"))])
        first = settled(rows.where(F.col("p") >= F.element_at(floors, F.col("model"))).withColumn("n", F.lit(1)))
        found |= summed(_by_ranges(first, [F.desc("p"), "_o"], cluster, place, ["n"], topped, schema, rows_per_range))
    out = []
    for m, t in totals.items():
        n, pos = t.T
        neg, tp, fp = n - pos, found[m, "tp"], found[m, "fp"]
        both = (pos > 0) & (neg > 0)
        value = {"roc_auc": np.where(both, found[m, "won"] / np.maximum(pos * neg, 1), np.nan), "average_precision": np.where(both, found[m, "ap"] / np.maximum(pos, 1), np.nan), "f1": 2 * tp / np.maximum(tp + fp + pos, 1)}
        for name, k in zip(("05", "10"), size[m]):
            if (m, f"hits{name}") not in found:
                continue
            hits = found[m, f"hits{name}"]
            value[f"top{name}_f1"] = np.where(hits > 0, 2 * hits / np.maximum(k + pos, 1), 0.0)
            ideal = _discount(table, np.minimum(k, pos).astype(np.int64))
            value[f"top{name}_ndcg"] = np.where(ideal > 0, found[m, f"dcg{name}"] / np.where(ideal > 0, ideal, 1), np.nan)
        out += [(i, m, *(None if np.isnan(value[c][i]) else float(value[c][i]) for c in names)) for i in range(draws)]
    return scores.sparkSession.createDataFrame(out, "iteration int, model string, " + ", ".join(f"{c} double" for c in names))


def bootstrap_interval(metrics: DataFrame, baseline: str, candidate: str, column: str) -> DataFrame:
    """Mean, 2.5 and 97.5 % points and the share above 0 of paired differences."""
    of = lambda name: F.max(F.when(F.col("model") == name, F.col(column)))
    d = metrics.groupBy("iteration").agg((of(candidate) - of(baseline)).alias("d"))
    return d.agg(
        F.lit(column).alias("metric"), F.avg("d").alias("mean_delta"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"),
        F.avg((F.col("d") > 0).cast("double")).alias("share_above_0"), F.count("d").alias("iterations"),
    )


def fold_bootstrap(deltas: DataFrame, times: DataFrame) -> DataFrame:
    """Means of fold differences (fold, delta) in resamples of the folds, by a
    table of draws (iteration, fold, times) such as ``splits.draws`` gives."""
    d = deltas.join(times, "fold")
    means = d.groupBy("iteration").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("m"))
    return means.agg(F.avg("m").alias("mean_delta"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def random_control(control: DataFrame, observed: DataFrame, value: str) -> DataFrame:
    """Where an observed value stands among random repeats: mean, p95, the
    empirical p and the percentile of the observed value."""
    o = observed.select(F.col(value).alias("observed"))
    x = F.col(value)
    return control.crossJoin(F.broadcast(o)).groupBy("observed").agg(
        F.count(x).alias("repeats"), F.avg(x).alias("control_mean"), F.percentile(value, F.lit(0.95)).alias("control_p95"),
        stats.empirical_p(F.col("observed"), x).alias("empirical_p"), F.avg((x < F.col("observed")).cast("double")).alias("percentile"),
    )


def distinct_top(df: DataFrame, by: Sequence[str], cluster: str, budget: float, order: str = "row_index", y: str = "y", p: str = "p") -> DataFrame:
    """Different positive clusters in the top rows of each group, beside the
    positive rows and the duplicates among them."""
    rows = df.select(*by, F.col(cluster).alias(cluster), F.col(y).alias(y), F.col(p).alias("_p"), F.col(order).alias("_o"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    r = ranges.join_groups(guards.number_within(rows, by, [F.desc("_p"), "_o"], "_rn"), totals, by).withColumn("_top", F.col("_rn") < top_size(F.col("_n"), budget))
    hit = (F.col(y) == 1) & F.col("_top")
    out = r.groupBy(*by).agg(
        F.count_if("_top").alias("candidate_rows"), F.count_if(hit).alias("positive_rows"), F.count_distinct(F.when(hit, F.col(cluster))).alias("clusters_hit"),
        F.count_distinct(F.when(F.col(y) == 1, F.col(cluster))).alias("clusters"),
    )
    return out.withColumns({"duplicates": F.col("positive_rows") - F.col("clusters_hit"), "cluster_recall": F.try_divide(F.col("clusters_hit"), F.col("clusters"))})


def pooled_foldwise(folds: DataFrame, by: Sequence[str], sums: Sequence[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of sums over folds {name: (numerator, denominator)}, another
    estimand than means of the folds' ratios; null where nothing is summed."""
    total = folds.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    return total.withColumns({n: F.try_divide(F.col(a), F.col(b)) for n, (a, b) in ratios.items()})


def duplicate_audit(df: DataFrame, kinds: dict[str, Column], label: str, region: str) -> DataFrame:
    """For each kind of key the groups of more than one row, their rows, and
    how many mix labels or regions. Null keys are no key."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()])
    long = df.select(F.col(label).alias("label"), F.col(region).alias("region"), F.inline(keys)).where("key is not null")
    groups = long.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("region").alias("r0"), F.max("region").alias("r1")).where("n > 1")
    return groups.groupBy("kind").agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.count_if(F.col("l0") != F.col("l1")).alias("n_label_conflicts"), F.count_if(F.col("r0") != F.col("r1")).alias("n_cross_region")
    )


def perturbation_effect(df: DataFrame, original: str, scenarios: dict[str, str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Changes of a score under scenarios {name: column}: mean, and of the
    absolute change mean, median, 95 % point, maximum and share over 0.05.
    ``weight`` counts a row so many times; equal changes meet first."""
    one = F.col(weight) if weight else F.lit(1)
    long = df.select(*by, one.alias("_w"), F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), (F.col(c) - F.col(original)).alias("d")) for n, c in scenarios.items()])))
    keys, a, w = [*by, "scenario"], F.abs("d"), F.col("_w")
    cells = settled(long.groupBy(*keys, "d").agg(F.sum("_w").alias("_w")).withColumn("a", a))
    n = F.sum(F.when(F.col("d").isNotNull(), w))
    mean = lambda x: F.try_divide(F.sum(x * w), n)
    plain = cells.groupBy(*keys).agg(mean(F.col("d")).alias("mean_delta"), mean(F.col("a")).alias("mean_abs_delta"), F.max("a").alias("max_abs_delta"), mean((F.col("a") > 0.05).cast("double")).alias("share_over_005"))
    q = ranges.quantiles(cells, keys, "a", (0.5, 0.95), weight="_w")
    return ranges.join_groups(plain, q, keys).select(*keys, "mean_delta", "mean_abs_delta", F.col("q")[0].alias("median_abs_delta"), F.col("q")[1].alias("p95_abs_delta"), "max_abs_delta", "share_over_005")


#: Parts of a column's name, in any case, that tell a temperature.
TEMPERATURE = ("tmean", "tmax", "tmin", "dtr", "temperature")
#: By how much a scenario moves temperatures, and all others by
#: factor.
SHIFTS = {"original": (0.0, 1.0), "plus": (1.0, 1.1), "minus": (-1.0, 0.9)}


def perturbed(columns: Sequence[str], scenario: str, medians: dict[str, float] | None = None, of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Climate columns under original, plus, minus or train_median: plus and
    minus move temperatures by a degree and all others by a tenth. ``of``
    gives a column's values."""
    if scenario == "train_median":
        return {c: F.lit(float((medians or {})[c])) for c in columns}
    if scenario not in SHIFTS:
        raise ValueError(f"unknown scenario {scenario}")
    step, factor = SHIFTS[scenario]
    warm = lambda c: any(t in c.lower() for t in TEMPERATURE)
    return {c: of(c) if scenario == "original" else of(c) + step if warm(c) else of(c) * factor for c in columns}
