"""Recipes with a ridge score, all folds and models at once.

All that the recipes of a fold need of its training rows are the medians and
the products of their columns, which ``training`` takes from one pass over all
rows by subtraction. Residuals are
linear in the columns they are made of, so every recipe is solved from its
fold's one table of products, and all scores are one projection of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import evaluate, stats
from . import recipe, training


@dataclass
class FoldModels:
    """Medians and products of the training rows of each fold, and what was
    solved from them: (model, fold, intercept, weight of each column)."""

    columns: list[str]
    label: str
    fold: str
    medians: dict[Any, dict[str, float]]
    grams: dict[Any, stats.Gram]
    solved: list[tuple[str, Any, float, list[float]]] = field(default_factory=list)

    def made(self, fold: Any, raw: Sequence[str], residual: Sequence[str] = (), climate: Sequence[str] = (), residual_alpha: float = 10.0, g: stats.Gram | None = None) -> np.ndarray:
        """The map from the filled columns (and the label) to a fold's
        features: raw ones, then residuals on the climate columns."""
        g = g or self.grams[fold]
        at = {c: i for i, c in enumerate(g.names)}
        made = np.zeros((len(g.names), len(raw) + len(residual)))
        for j, c in enumerate(raw):
            made[at[c], j] = 1.0
        if residual:
            c, t = [at[x] for x in climate], [at[x] for x in residual]
            s = _scale(np.diag(g.cov)[c])
            w = np.linalg.solve(g.n * g.cov[np.ix_(c, c)] / np.outer(s, s) + residual_alpha * np.eye(len(c)), g.n * g.cov[np.ix_(c, t)] / s[:, None])
            for j, x in enumerate(t):
                made[x, len(raw) + j] += 1.0
                made[c, len(raw) + j] -= w[:, j] / s
        return made

    def add(self, model: str, fold: Any, raw: Sequence[str], residual: Sequence[str] = (), climate: Sequence[str] = (), residual_alpha: float = 10.0, alpha: float = 10.0, label: str | None = None, mix: np.ndarray | None = None) -> None:
        """Solve one model of one fold: a ridge of the label (or of another
        column) on raw columns and on residuals of others on the climate
        columns, all scaled by the training deviation. ``mix`` makes columns
        of columns first, about their means."""
        g = self.grams[fold]
        at = {c: i for i, c in enumerate(g.names)}
        if mix is not None:
            g = stats.Gram(g.names, g.n, g.mean, mix.T @ g.cov @ mix)
        made = self.made(fold, raw, residual, climate, residual_alpha, g)
        cov = made.T @ g.cov @ made
        s, y = _scale(np.diag(cov)), at[label or self.label]
        w = np.linalg.solve(g.n * cov / np.outer(s, s) + alpha * np.eye(len(s)), g.n * (made.T @ g.cov[:, y]) / s)
        b = made @ (w / s)
        b = b if mix is None else mix @ b
        self.solved.append((model, fold, float(g.mean[y] - b @ g.mean), [float(b[at[c]]) for c in self.columns]))

    def climate_axis(self, fold: Any, climate: Sequence[str]) -> np.ndarray:
        """Weights of the columns in a fold's climate score: the first
        component of the scaled climate columns, of deviation 1 among the
        training rows (its sign as ``stats.ClimateScore`` has it)."""
        g = self.grams[fold]
        at = [g.names.index(c) for c in climate]
        s = _scale(np.diag(g.cov)[at])
        values, vectors = np.linalg.eigh(g.cov[np.ix_(at, at)] / np.outer(s, s))
        v = vectors[:, -1]
        v = v * np.sign(v[np.argmax(np.abs(v) >= np.abs(v).max() - 1e-9)])
        out = np.zeros(len(g.names))
        out[at] = v / s / (np.sqrt(max(values[-1], 0.0)) or 1.0)
        return out

    def contaminated(self, fold: Any, columns: Sequence[str], climate: Sequence[str], gamma: float) -> np.ndarray:
        """The ``mix`` that adds ``gamma`` training deviations of the climate
        score to each of the columns. They must lack no value, as one that is
        missing would stay missing."""
        g, axis = self.grams[fold], self.climate_axis(fold, climate)
        mix = np.eye(len(g.names))
        for c in columns:
            i = g.names.index(c)
            mix[:, i] += gamma * _scale(np.diag(g.cov)[[i]])[0] * axis
        return mix

    def table(self, df: DataFrame) -> DataFrame:
        """One row for each fold: its medians and its models, a bounded catalogue."""
        rows = [(f, [m[c] for c in self.columns], [(n, b0, b) for n, of, b0, b in self.solved if of == f]) for f, m in self.medians.items()]
        return df.sparkSession.createDataFrame(rows, f"_fold {'string' if all(isinstance(f, str) for f in self.medians) else dict(df.dtypes)[self.fold]}, _fill array<double>, _models array<struct<model:string,b0:double,b:array<double>>>")

    def score(self, df: DataFrame, keep: Sequence[str], values: Mapping[str, Column] | None = None) -> DataFrame:
        """(model, keep..., p): every row by the models of its own fold, which
        did not see it. ``values`` replaces columns; nulls take the training
        median."""
        table = self.table(df)
        of = {c: F.col(c) for c in self.columns} | dict(values or {})
        filled = [F.coalesce(of[c].cast("double"), F.get("_fill", F.lit(i))).alias(f"_x{i}") for i, c in enumerate(self.columns)]
        met = df.join(F.broadcast(table), F.col(self.fold) == F.col("_fold")).select(*keep, *filled, F.explode("_models").alias("_m"))
        dot = F.lit(0.0)
        for i in range(len(self.columns)):
            dot = dot + F.col(f"_x{i}") * F.get("_m.b", F.lit(i))
        return met.select(F.col("_m.model").alias("model"), *keep, (F.col("_m.b0") + dot).alias("p"))

    def alike(self) -> tuple[FoldModels, list[tuple[str, Any, str]]]:
        """The different models of each fold, named by numbers, and (number,
        fold, model) of all: models that are equal score alike."""
        found: dict[tuple, str] = {}
        names = [(found.setdefault((f, b0, *b), str(len(found))), f, name) for name, f, b0, b in self.solved]
        once = [(number, f, b0, list(b)) for (f, b0, *b), number in found.items()]
        return FoldModels(self.columns, self.label, self.fold, self.medians, self.grams, once), names


def _named(df: DataFrame, rows: DataFrame, names: list[tuple[str, Any, str]], fold: str) -> DataFrame:
    """``df`` by the numbers of different models, for all models by name."""
    table = rows.sparkSession.createDataFrame(names, f"model string, {fold} {dict(rows.dtypes)[fold]}, _name string")
    return df.join(F.broadcast(table), ["model", fold]).withColumn("model", F.col("_name")).drop("_name")


#: Share of different rows from which equal ones are not looked for.
REPEATED = 0.5


def metrics(models: FoldModels, df: DataFrame, digits: int = 9) -> DataFrame:
    """``evaluate.classification_metrics`` of every row by the models of its
    own fold, scores to so many digits. Rows of equal columns meet before they
    are scored (where they are many), and equal models (a selection that takes nothing, a control
    that draws the same columns) score once."""
    once, names = models.alike()
    columns = [models.fold, models.label, *models.columns]
    size = df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*columns)).alias("cells")).first()
    met = lambda d, *by: d.groupBy(*by).agg(F.sum("_rows").alias("_rows"))
    cells = df.select(*columns, F.lit(1).cast("long").alias("_rows"))
    # a guess, on which no result rests: rows that hardly ever meet are not shuffled for it
    cells = met(cells, *columns) if size["cells"] < REPEATED * size["n"] else cells
    # rows of models without a weight share one score
    flat = [not any(b) for *_, b in once.solved]
    part = lambda on: replace(once, solved=[m for m, f in zip(once.solved, flat) if f == on])
    keep = [models.fold, models.label, "_rows"]
    scores = part(False).score(cells, keep)
    scores = scores.unionByName(part(True).score(met(cells, *keep[:2]).select(*keep, *[F.lit(0.0).alias(c) for c in models.columns]), keep)) if any(flat) else scores
    most = size["n"] * max(Counter(f for _, f, *_ in once.solved).values(), default=1)
    return _named(evaluate.classification_metrics(scores.withColumn("p", F.round("p", digits)), ["model", models.fold], y=models.label, weight="_rows", most=most), df, names, models.fold)


def _scale(variance: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(variance, 0))
    return np.where(sd > 1e-9, sd, 1.0)


def fit_folds(df: DataFrame, columns: Sequence[str], label: str, fold: str = "fold") -> FoldModels:
    """Medians and products of each fold's training rows with a label."""
    rows = df.where(F.col(label).isNotNull()).select(fold, label, *columns)
    folds = training.fold_names(rows, fold)
    fills = training.medians(rows, columns, fold, folds)
    products = training.grams(rows, columns, label, fold, folds, fills)
    return FoldModels(list(columns), label, fold, {f: fills.get((f,), dict.fromkeys(columns, 0.0)) for (f,) in products}, {f: g for (f,), g in products.items()})


def fit_buffered(df: DataFrame, columns: Sequence[str], label: str, key: str, radii: Sequence[float], fold: str = "fold", lat: str = "lat", lon: str = "lon") -> FoldModels:
    """Medians and products of each fold's training rows outside a buffer
    around its test rows, for no buffer and all ``radii`` from one pass. Folds
    are named <fold>/<radius>, as ``at_radii`` names the test rows."""
    rows = df.where(F.col(label).isNotNull())
    folds, radii = training.fold_names(rows, fold), sorted(map(float, radii))
    parts = settled(training.buffered(rows, fold, folds, key, radii, lat, lon).select("_out", label, *columns))
    sets = training.buffered_sets(folds, radii)
    fills = training.medians_of_sets(parts, columns, sets)
    products = training.grams_of_sets(parts, columns, label, sets, fills)
    name = lambda s: f"{s[0]}/{s[1]:g}"
    return FoldModels(list(columns), label, fold, {name(s): fills[s] for s in products}, {name(s): g for s, g in products.items()})


def at_radii(df: DataFrame, radii: Sequence[float], fold: str = "fold") -> DataFrame:
    """Each test row once for no buffer and for every radius."""
    each = F.explode(F.array(*[F.lit(f"{r:g}") for r in (0.0, *sorted(map(float, radii)))]))
    return df.withColumn("_radius", each).withColumn(fold, F.concat_ws("/", F.col(fold).cast("string"), F.col("_radius"))).drop("_radius")


def own_grams(df: DataFrame, models: FoldModels) -> dict[Any, stats.Gram]:
    """Products of each fold's own rows, filled with its training medians."""
    rows = df.where(F.col(models.label).isNotNull()).select(models.fold, models.label, *models.columns)
    fills = {(f,): m for f, m in models.medians.items()}
    return {f: g for (f,), g in training.grams(rows, models.columns, models.label, models.fold, list(models.medians), fills, own=True).items()}


def contamination(models: FoldModels, own: Mapping[Any, stats.Gram], columns: Sequence[str], climate: Sequence[str], gammas: Sequence[float], recipes: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> list[tuple]:
    """Add every recipe (raw and residualised columns) at every strength of
    contamination to the models, as <recipe>/<gamma>, and measure the columns
    in the held-out rows: (gamma, model, fold, recovery, damage, climate_r2).

    ``recovery`` is the root mean square of the columns' distance from the
    clean ones in training deviations, ``damage`` that of the residualised
    columns that were not contaminated (null without any), ``climate_r2`` how
    well a ridge on the climate foretells the contaminated columns. All of it
    follows from the products of the clean columns: no pass for a strength."""
    out = []
    for f, g in models.grams.items():
        test, at = own.get(f), {c: i for i, c in enumerate(g.names)}
        moment = None if test is None else test.cov + np.outer(test.mean - g.mean, test.mean - g.mean)  # about the training means
        for gamma in gammas:
            mix = models.contaminated(f, columns, climate, gamma)
            mixed = stats.Gram(g.names, g.n, g.mean, mix.T @ g.cov @ mix)
            for name, (raw, residual) in recipes.items():
                models.add(f"{name}/{gamma:g}", f, raw, residual, climate, mix=mix)
                if test is None:
                    continue
                made = mix @ models.made(f, raw, residual, climate, g=mixed)  # of the clean columns, about their means
                place = {c: j for j, c in enumerate([*raw, *residual])}

                def distance(names: Sequence[str]) -> float | None:
                    errors = []
                    for c in (c for c in names if c in place):
                        e = made[:, place[c]].copy()
                        e[at[c]] -= 1.0
                        shift = -g.mean[at[c]] if c in residual else 0.0  # residuals are about 0
                        errors.append((e @ moment @ e + 2 * shift * (e @ (test.mean - g.mean)) + shift**2) / _scale(np.diag(g.cov)[[at[c]]])[0] ** 2)
                    return float(np.sqrt(max(np.mean(errors), 0.0))) if errors else None

                t, c = made[:, [place[x] for x in columns if x in place]], [at[x] for x in climate]
                s = _scale(np.diag(g.cov)[c])
                w = np.linalg.solve(g.n * g.cov[np.ix_(c, c)] / np.outer(s, s) + 10.0 * np.eye(len(c)), g.n * (g.cov @ t)[c] / s[:, None]) / s[:, None]
                e = t.copy()
                e[c] -= w
                sse, sst = np.einsum("ij,ik,kj->", e, moment, e), np.einsum("ij,ik,kj->", t, test.cov, t)
                out.append((float(gamma), name, f, distance(columns), distance([x for x in residual if x not in columns]), float(1 - sse / sst) if sst > 0 else None))
    return out


def ranked_pairs(df: DataFrame, targets: Sequence[str], climate: Sequence[str], fold: str = "fold") -> DataFrame:
    """Rank correlations of each fold's training rows, settled: screens and
    graphs both read them."""
    return settled(training.spearman(df.select(fold, *targets, *climate), targets, climate, fold, training.fold_names(df, fold)))


def sensitive_by_fold(df: DataFrame, targets: Sequence[str], climate: Sequence[str], threshold: float = 0.30, fold: str = "fold", pairs: DataFrame | None = None) -> dict[Any, set[str]]:
    """Targets that the rank screen of each fold's training rows finds
    sensitive; ``pairs`` may hold the correlations already."""
    pairs = ranked_pairs(df, targets, climate, fold) if pairs is None else pairs.where(F.col("target").isin(list(targets)) & F.col("covariate").isin(list(climate)))
    out: dict[Any, set[str]] = {}
    for r in stats.spearman_screen(pairs, threshold, by=["test_fold"], covariates=climate).where("is_spearman_sensitive").collect():
        out.setdefault(r["test_fold"], set()).add(r["target_column"])
    return out


def with_recipes(models: FoldModels, sets: Mapping[str, Sequence[str]], recipes: Sequence[str], sensitive: Mapping[Any, set[str]], graph: Mapping[Any, set[str]] | None = None, prefix: str = "") -> FoldModels:
    """Add the named recipes in every fold, with the fold's own sensitive
    columns and its own graph's (a frozen one's, where a run is replayed)."""
    for f in models.grams:
        for name in recipes:
            raw, residual = recipe.columns_of(name, sets, sensitive.get(f, set()), (graph or {}).get(f, set()))
            models.add(prefix + name, f, raw, residual, sets["climate_adjusters"])
    return models


#: Views of the features and how they are adjusted.
VIEWS = ("geochemistry_only", "multimodal_no_climate")
ADJUSTMENTS = ("raw", "m3_broad", "m4_spearman")


def with_matched_views(models: FoldModels, sets: Mapping[str, Sequence[str]], sensitive: Mapping[Any, set[str]]) -> FoldModels:
    """Six models a fold, named view/adjustment: the same columns raw, with
    all geochemistry residualised, or with the sensitive part of it."""
    for f in models.grams:
        for view, base in zip(VIEWS, (sets["geochemistry"], sets["no_climate"])):
            for adjustment, chosen in zip(ADJUSTMENTS, (set(), set(sets["geochemistry"]), sensitive.get(f, set()))):
                models.add(f"{view}/{adjustment}", f, [c for c in base if c not in chosen], [c for c in base if c in chosen], sets["climate_adjusters"])
    return models


def with_random_controls(models: FoldModels, sets: Mapping[str, Sequence[str]], chosen: Mapping[tuple[Any, int], Sequence[str]]) -> FoldModels:
    """One model for each (fold, repeat) with its random columns residualised
    in place of the selected ones: RandomMatched/<repeat>."""
    base = sets["no_climate"]
    for (f, repeat), columns in chosen.items():
        models.add(f"RandomMatched/{repeat}", f, [c for c in base if c not in set(columns)], [c for c in base if c in set(columns)], sets["climate_adjusters"])
    return models


def perturbation(models: FoldModels, df: DataFrame, keys: Sequence[str], climate: Sequence[str], digits: int = 9) -> DataFrame:
    """Statistics of the changes of every row's score under plus, minus and
    the training medians of its fold against the original climate, by model,
    fold and scenario. ``keys`` tell a row within a fold; rows of equal keys
    count together by their sums, so give a key.

    All scenarios of a row are scored where it is. Keys whose rows have equal
    columns meet before that, and equal models score once."""
    once, names = models.alike()
    table, fold = once.table(df), models.fold
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in models.columns])
    keyed = df.groupBy(fold, *keys).agg(F.sort_array(F.collect_list(row)).alias("_of"))
    sets = settled(keyed.groupBy(fold, "_of").agg(F.count("*").alias("_keys")))
    met = sets.join(F.broadcast(table), F.col(fold) == F.col("_fold")).withColumn("_m", F.explode("_models"))
    used = [c for c in climate if c in models.columns]

    def score(scenario: str) -> Column:
        def one(x: Column) -> Column:
            moved = {c: F.lit(None).cast("double") for c in used} if scenario == "train_median" else evaluate.perturbed(used, scenario, of=lambda c: x[c])
            dot = F.lit(0.0)
            for i, c in enumerate(models.columns):
                dot = dot + F.coalesce(moved.get(c, x[c]), F.get("_fill", F.lit(i))) * F.get("_m.b", F.lit(i))
            return F.round(F.col("_m.b0") + dot, digits)

        return F.aggregate("_of", F.lit(0.0), lambda a, x: a + one(x))

    scenarios = [*evaluate.SHIFTS, "train_median"]
    wide = met.select(F.col("_m.model").alias("model"), fold, "_keys", *[score(s).alias(s) for s in scenarios])
    report = evaluate.perturbation_effect(wide, "original", {s: s for s in scenarios if s != "original"}, ["model", fold], weight="_keys")
    return _named(report, df, names, fold)


def held_out_predictability(df: DataFrame, sources: Sequence[str], targets: Sequence[str], fold: str = "fold") -> DataFrame:
    """How well a ridge on ``sources`` foretells ``targets`` in rows that it
    did not see: (fold, r2, mean_spearman), the first weighted by the targets'
    variances, the second the mean rank correlation of a target with its
    forecast. Missing values take the training medians on both sides."""
    columns = [*sources, *targets]
    models = fit_folds(df.withColumn("_one", F.lit(1)), columns, "_one", fold)
    for f in models.grams:
        for t in targets:
            models.add(t, f, sources, label=t)
    table = models.table(df).select("_fold", F.slice("_fill", len(sources) + 1, len(targets)).alias("_t"))
    observed = F.element_at(F.create_map(*[x for i, t in enumerate(targets) for x in (F.lit(t), F.coalesce(F.col(t).cast("double"), F.get("_t", F.lit(i))))]), F.col("model"))
    scored = models.score(df, [fold, *targets]).join(F.broadcast(table), F.col(fold) == F.col("_fold"))
    # forecasts to nine digits, so that equal rows tie
    seen = settled(scored.select(fold, "model", F.round("p", 9).alias("p"), observed.alias("o")))
    sums = seen.groupBy(fold, "model").agg(F.sum(F.pow(F.col("o") - F.col("p"), 2)).alias("e"), (F.var_pop("o") * F.count("o")).alias("t"))
    ranks = stats.spearman_pairs(seen, ["o"], ["p"], 2, by=[fold, "model"]).groupBy(F.col(fold).alias("_f")).agg(F.avg("spearman").alias("mean_spearman"))
    out = sums.groupBy(fold).agg((1 - F.try_divide(F.sum("e"), F.sum("t"))).alias("r2"))
    return out.join(ranks, F.col(fold).eqNullSafe(F.col("_f")), "left").select(fold, "r2", "mean_spearman")
