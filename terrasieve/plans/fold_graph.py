"""A sensitivity graph for every fold, discovered in its training rows only.

All folds go through each step together, told apart by ``test_fold``: effects
in each environment, votes over environments, edges among the candidates,
their consensus, rank correlations with climate, and the fusion of all three.
What steps read of the rows comes from ``training`` and ``logistic``, so that
a row is not copied for the folds that train on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import graph, stats
from . import logistic, training


@dataclass
class Rules:
    """Thresholds of the steps; the defaults are those of the studies."""

    auc: float = 0.30
    rate: float = 0.50
    top_rank: int = 12
    partial: float = 0.18
    p: float = 0.20
    most_edges: int = 45
    spearman: float = 0.30
    score: float = 0.50


@dataclass
class FoldGraphs:
    """Tables of all folds, by ``test_fold``."""

    signals: DataFrame
    edges: DataFrame
    consensus: DataFrame
    fused: DataFrame

    def targets(self) -> dict[Any, set[str]]:
        """The targets that each fold's selected edges reach."""
        out: dict[Any, set[str]] = {}
        for r in self.fused.where("selected").select("test_fold", "target").distinct().collect():  # folds x columns
            out.setdefault(r["test_fold"], set()).add(r["target"])
        return out

    def summary(self) -> DataFrame:
        """What each fold's graph is made of: stable signals, candidates, edges
        of two environments or more, and targets."""
        count = lambda d, c: d.groupBy("test_fold").agg(F.count("*").alias(c))
        signals = self.signals.groupBy("test_fold").agg(F.count_if("is_candidate").alias("n_candidates"), F.count_if(F.col("n_selected") > 0).alias("n_signals"))
        parts = (count(self.consensus.where("env_count >= 2"), "n_edges"), count(self.fused.where("selected").select("test_fold", "target").distinct(), "n_targets"))
        for p in parts:
            signals = signals.join(p, "test_fold", "left")
        return signals.fillna(0, ["n_edges", "n_targets"])


def partial_edges(grams: Mapping[tuple, stats.Gram], candidates: Mapping[Any, Sequence[str]], label: str, rules: Rules, chosen: Mapping[tuple, set[str]]) -> list[tuple]:
    """(test_fold, environment, a, b, partial_corr, partial_p, by partial, by
    the sparse model) of all pairs of a fold's candidates and the label, from
    the products of its training rows in each environment."""
    out = []
    for (f, e), g in sorted(grams.items(), key=lambda x: repr(x[0])):
        names = [*candidates.get(f, ()), label]
        part = g.part(names).scaled()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                r, p = stats.ridge_partial_corr(part, a, b)
                out.append((f, str(e), a, b, r, p, bool(abs(r) >= rules.partial and p <= rules.p), b == label and a in chosen.get((f, e), ())))
    return out


def discover(
    df: DataFrame, columns: Sequence[str], label: str, groups: Mapping[str, str], targets: Sequence[str], climate: Sequence[str], env: str, fold: str = "fold",
    rules: Rules | None = None, sparse: bool = True, evidence: DataFrame | None = None, pairs: DataFrame | None = None,
) -> FoldGraphs:
    """The graphs of all folds. ``groups`` names each column's group.

    A column votes in an environment by its AUC, by the sparse logistic model
    that selects it (``sparse``), and by ``evidence`` (test_fold, env, concept
    and a selection ``rate`` or an ``importance``, ranked here). Columns that
    two environments select are candidates; the edges among them and the label
    give the causal score of (climate, target), rank correlations and the rank
    screen the other two; ``pairs`` may hold them already (``ranked_pairs``).
    Folds and environments are bounded catalogues. ``df`` is read more than
    once: give settled rows."""
    rules = rules or Rules()
    rows = df.where(F.col(label).isNotNull()).select(fold, env, label, *columns)
    folds, n_env = training.fold_names(rows, fold), rows.select(env).distinct().count()
    kind = dict(rows.dtypes)[fold]
    fills = training.medians(rows, columns, fold, folds, [env])
    grams = training.grams(rows, columns, label, fold, folds, fills, [env])
    models = logistic.fit_all(rows, columns, label, fold, [env], fills=fills, grams=grams) if sparse else {}
    spark = df.sparkSession

    votes = training.effects(rows, env, label, columns, fold, folds)
    # thresholds meet values to nine digits, so that the order of sums decides nothing
    votes = votes.withColumn("auc_strength", F.round("auc_strength", 9))
    if sparse:
        kinds = f"env {dict(rows.dtypes)[env]}, test_fold {kind}, concept string, coefficient double"
        found = [(e, f, c, b if abs(b) > 1e-9 else 0.0) for e, f, c, b in logistic.coefficients(models)]
        votes = votes.join(F.broadcast(spark.createDataFrame(found, kinds)), ["env", "test_fold", "concept"], "left")
    if evidence is not None:
        votes = votes.join(evidence, ["env", "test_fold", "concept"], "left")
    has = lambda c: c if c in votes.columns else None
    signals = settled(graph.vote_signals(votes, n_env, rules.auc, rules.rate, rules.top_rank, has("rate"), has("importance"), has("coefficient"), by=["test_fold"]))
    candidates: dict[Any, list[str]] = {}
    for r in signals.where("is_candidate").select("test_fold", "concept").collect():  # folds x columns
        candidates.setdefault(r["test_fold"], []).append(r["concept"])
    candidates = {f: [c for c in columns if c in found] for f, found in candidates.items()}

    chosen = {key: set(m.selected()) for key, m in models.items()}
    schema = f"test_fold {kind}, environment string, a string, b string, partial_corr double, partial_p double, selected_by_partial_corr boolean, selected_by_target_logistic boolean"
    raw = spark.createDataFrame(partial_edges(grams, candidates, label, rules, chosen), schema)
    named = F.create_map(*[F.lit(x) for c, g in {**groups, label: "target"}.items() for x in (c, g)])
    group = lambda c: F.coalesce(F.element_at(named, F.col(c)), F.lit("unknown"))
    edges = graph.orient(raw.withColumns({"group_a": group("a"), "group_b": group("b")}))
    edges = settled(graph.strongest_edges(edges, rules.most_edges, rules.p, by=["test_fold"]))
    consensus = settled(graph.edge_consensus(edges, n_env, by=["test_fold"]))

    pairs = settled(training.spearman(rows, targets, climate, fold, folds)) if pairs is None else pairs
    screen = stats.spearman_screen(pairs, rules.spearman, by=["test_fold"], covariates=climate).where("best_climate_column is not null")
    m4 = screen.select("test_fold", F.col("best_climate_column").alias("climate"), F.col("target_column").alias("target"), F.col("is_spearman_sensitive").cast("double").alias("sensitive_rate"))
    size = pairs.select("test_fold", F.col("covariate").alias("climate"), "target", F.abs("spearman").alias("global_abs"))
    fused = graph.fuse_sensitivity(size, m4, graph.climate_projection(consensus, by=["test_fold"]), rules.score, by=["test_fold"])
    return FoldGraphs(signals, edges, consensus, settled(fused))
