"""Queries of the fold experiments with a ridge score, and their SQL.

Line items are samples, their regions both environments and folds; quantity
and price stand for geochemistry, discount and tax for climate. The score is
a ridge, which SQL can solve: each query's SQL builds medians, residuals,
scales and normal equations of every fold by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import settled
from .operators import catalog, evaluate, guards, series, spatial, splits, stats
from .plans import boosting, experiments, fold_graph, linear, logistic, recipe
from .queries import ITEMS, METRICS, POINTS, Z_COLUMNS, Z_SQL, items, km_sql, metrics_sql, points, query, r, rounded, table

FEATURES = ("qty", "price", "disc", "tax")
SETS = {"full": ["qty", "price", "disc", "tax"], "no_climate": ["qty", "price"], "core_geo": ["qty", "price"], "climate_adjusters": ["disc", "tax"], "geochemistry": ["qty", "price"]}
RECIPES = ("Full", "CoreGeo", "NoClimate", "M3_Broad", "M4_Spearman", "M4_GraphGuided", "M4_GraphUnion")
#: A rank correlation from which a column counts as sensitive on these tables.
SENSITIVE = 0.004
#: The graphs' other thresholds on these tables, and the group of each column.
GRAPH_RULES = fold_graph.Rules(auc=0.008, partial=0.002, spearman=SENSITIVE)
GROUPS = {"qty": "geochemistry", "price": "geochemistry", "disc": "climate", "tax": "climate"}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their region as fold and one row for each key."""
    it = items(spark, sf_dir).withColumn("fold", F.col("env"))
    return it.select("row_index", "y", "fold", "state", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def solved_sql(src: str, keys: str, n: int, out: str) -> str:
    """CTEs that end in ``out``(keys, w0, w1, ...): the solution of the n
    normal equations of each row of ``src`` (g_i_j and the right side g_i_n),
    one column eliminated in each."""
    ctes, last = [], src
    for k in range(n):
        cells = [f"g_{k}_{j} / g_{k}_{k} AS g_{k}_{j}" if i == k else f"g_{i}_{j} - g_{i}_{k} * g_{k}_{j} / g_{k}_{k} AS g_{i}_{j}" for i in range(n) for j in range(k + 1, n + 1)]
        ctes.append(f"{out}_{k} AS (SELECT {keys}, {', '.join(cells)} FROM {last})")
        last = f"{out}_{k}"
    return ", ".join([*ctes, f"{out} AS (SELECT {keys}, {', '.join(f'g_{i}_{n} AS w{i}' for i in range(n))} FROM {last})"])


ITEM_ROWS = f"{ITEMS}, b AS (SELECT row_index, y, env AS fold, state, qty::DOUBLE AS qty, price::DOUBLE AS price, disc::DOUBLE AS disc, tax::DOUBLE AS tax FROM it)"


def folds_sql(rows: str = ITEM_ROWS) -> str:
    """What models need of the training rows of each fold of b(row_index, y,
    fold, state, features): medians, means, scales, residual weights on both
    climate columns and on each alone, and sensitive columns."""
    return f"""{rows},
tr AS (SELECT f.fold AS tf, b.* FROM b, (SELECT DISTINCT fold FROM b) f WHERE b.fold <> f.fold),
md AS (SELECT tf, {', '.join(f'median({c}) AS m_{c}' for c in FEATURES)} FROM tr GROUP BY tf),
fl AS (SELECT tf, y, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)} FROM tr JOIN md USING (tf)),
st AS (SELECT tf, avg(y) AS a_y, {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM fl GROUP BY tf),
cg AS (SELECT tf, u, v, q, p FROM (SELECT tf, (disc - a_disc) / s_disc AS u, (tax - a_tax) / s_tax AS v, qty - a_qty AS q, price - a_price AS p FROM fl JOIN st USING (tf))),
cw AS (SELECT tf, (uq * vv - vq * uv) / (uu * vv - uv * uv) AS wq_u, (vq * uu - uq * uv) / (uu * vv - uv * uv) AS wq_v, (up * vv - vp * uv) / (uu * vv - uv * uv) AS wp_u, (vp * uu - up * uv) / (uu * vv - uv * uv) AS wp_v, uq / uu AS oq_u, vq / vv AS oq_v, up / uu AS op_u, vp / vv AS op_v
  FROM (SELECT tf, sum(u * u) + 10 AS uu, sum(v * v) + 10 AS vv, sum(u * v) AS uv, sum(u * q) AS uq, sum(v * q) AS vq, sum(u * p) AS up, sum(v * p) AS vp FROM cg GROUP BY tf)),
pr AS ({' UNION ALL '.join(f"SELECT tf, '{t}' AS target, '{c}' AS covariate, {t} AS a, {c} AS b FROM tr WHERE {t} IS NOT NULL AND {c} IS NOT NULL" for t in ('qty', 'price') for c in ('disc', 'tax'))}),
rk AS (SELECT tf, target, covariate, rank() OVER (PARTITION BY tf, target, covariate ORDER BY a) + (count(*) OVER (PARTITION BY tf, target, covariate, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY tf, target, covariate ORDER BY b) + (count(*) OVER (PARTITION BY tf, target, covariate, b) - 1) / 2.0 AS rb FROM pr),
se AS (SELECT tf, {', '.join(f"coalesce(bool_or(rho >= {SENSITIVE}) FILTER (target = '{t}'{more}), false) AS s_{t[0]}{x}" for t in ('qty', 'price') for x, more in (('', ''), ('_d', " AND covariate = 'disc'"), ('_t', " AND covariate = 'tax'")))}
  FROM (SELECT tf, target, covariate, abs(corr(ra, rb)) AS rho FROM rk GROUP BY ALL) GROUP BY tf)"""


BASE = folds_sql()


def graph_sql(zone: str = "state % 3") -> str:
    """CTEs that end in se2: ``se`` with the targets (g_q, g_p) of a graph
    discovered in each fold's training rows. Columns vote by their AUC in each
    zone; candidates of two zones or more are tied to each other by partial
    correlations (a p of 0.2 is a t of 1.2817 for so many rows)."""
    nodes = [*FEATURES, "y"]
    able = ["c0", "c1", "c2", "c3", "true"]
    cell = lambda i, j: f"CASE WHEN {able[i]} AND {able[j]} THEN r_{min(i, j)}_{max(i, j)} ELSE 0 END"
    sides = []
    for a in (0, 1):
        for b in (2, 3):
            rest = [k for k in range(5) if k not in (a, b)]
            for side, x in enumerate((a, b)):
                cells = [f"{cell(p, q)}{' + 1' if i == j else ''} AS g_{i}_{j}" for i, p in enumerate(rest) for j, q in enumerate(rest)] + [f"{cell(p, x)} AS g_{i}_3" for i, p in enumerate(rest)]
                others = " + ".join(f"({able[k]})::INT" for k in rest)
                sides.append(f"SELECT tf, z, '{nodes[a]}' AS target, '{nodes[b]}' AS climate, {side} AS side, n, {others} AS k, {able[a]} AND {able[b]} AS ok, r_{a}_{a} AS own, r_{a}_{b} AS both_, {', '.join(cells)} FROM gs")
    quad = lambda u, v: " + ".join(f"{u}.w{i} * {v}.w{j} * (a.g_{i}_{j}{' - 1' if i == j else ''})" for i in range(3) for j in range(3))
    dot = lambda u, v: " + ".join(f"{u}.w{i} * {v}.g_{i}_3" for i in range(3))
    scaled = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w <= 1e-9 * greatest(abs(min({c}) OVER w), abs(max({c}) OVER w)) THEN 1.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
    return f"""gz AS MATERIALIZED (SELECT tf, {zone} AS z, y, {', '.join(FEATURES)} FROM tr),
gl AS ({' UNION ALL '.join(f"SELECT tf, z, y, '{c}' AS concept, {c} AS v FROM gz WHERE {c} IS NOT NULL" for c in FEATURES)}),
gk AS (SELECT tf, z, concept, y, rank() OVER (PARTITION BY tf, z, concept ORDER BY v) + (count(*) OVER (PARTITION BY tf, z, concept, v) - 1) / 2.0 AS rk FROM gl),
ga AS (SELECT tf, z, concept, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM gk GROUP BY tf, z, concept),
gv AS (SELECT tf, concept, count(*) FILTER (round(2 * abs(auc - 0.5), 9) >= {GRAPH_RULES.auc}::DOUBLE) >= 2 AS able FROM ga GROUP BY tf, concept),
gc AS (SELECT tf, {', '.join(f"bool_or(able AND concept = '{c}') AS c{i}" for i, c in enumerate(FEATURES))} FROM gv GROUP BY tf),
gm AS (SELECT tf, z, {', '.join(f'median({c}) AS m_{c}' for c in FEATURES)} FROM gz GROUP BY tf, z),
gf AS (SELECT tf, z, y, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)} FROM gz JOIN gm USING (tf, z)),
gs AS MATERIALIZED (SELECT * FROM (SELECT tf, z, count(*) AS n, {', '.join(f'count(*) * coalesce(corr({a}, {b}), 0) AS r_{i}_{j}' for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i <= j)} FROM gf GROUP BY tf, z) JOIN gc USING (tf)),
sr AS MATERIALIZED ({' UNION ALL '.join(sides)}), {solved_sql('sr', 'tf, z, target, climate, side', 3, 'gw')},
pc AS (SELECT a.tf, a.z, a.target, a.climate, a.n, a.k, a.both_ - ({dot('u', 'b')}) - ({dot('v', 'a')}) + ({quad('u', 'v')}) AS s_ab, a.own - 2 * ({dot('u', 'a')}) + ({quad('u', 'u')}) AS s_aa, a.n - 2 * ({dot('v', 'b')}) + ({quad('v', 'v')}) AS s_bb
  FROM sr a JOIN sr b ON a.side = 0 AND b.side = 1 AND (a.tf, a.z, a.target, a.climate) = (b.tf, b.z, b.target, b.climate) AND a.ok
  JOIN gw u ON u.side = 0 AND (a.tf, a.z, a.target, a.climate) = (u.tf, u.z, u.target, u.climate) JOIN gw v ON v.side = 1 AND (a.tf, a.z, a.target, a.climate) = (v.tf, v.z, v.target, v.climate)),
ge AS (SELECT tf, climate, target, count(*) / 3 AS c FROM (SELECT *, s_ab / sqrt(s_aa * s_bb) AS rho FROM pc) WHERE abs(rho) >= {GRAPH_RULES.partial}::DOUBLE AND abs(rho) * sqrt((n - k - 2) / (1 - rho * rho)) >= 1.2817 GROUP BY tf, climate, target),
gp AS (SELECT tf, target, covariate AS climate, abs(corr(ra, rb)) AS g FROM rk GROUP BY ALL),
gb AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tf, target ORDER BY g DESC, climate) = 1 AND g >= {SENSITIVE} THEN 1.0 ELSE 0.0 END AS m FROM gp),
gj AS (SELECT gb.*, coalesce(ge.c, 0.0)::DOUBLE AS c FROM gb LEFT JOIN ge USING (tf, climate, target)),
gx AS (SELECT tf, target, 0.45 * {scaled('g')} + 0.35 * {scaled('m')} + 0.20 * {scaled('c')} >= 0.5 AS sel FROM gj WINDOW w AS (PARTITION BY tf)),
gt AS (SELECT tf, bool_or(sel AND target = 'qty') AS g_q, bool_or(sel AND target = 'price') AS g_p FROM gx GROUP BY tf),
se2 AS (SELECT se.*, g_q, g_p FROM se JOIN gt USING (tf))"""


GRAPH_BASE = f"{BASE}, {graph_sql()}"
#: model: how quantity, price, discount and tax enter (0 not, 1 raw, 2 residual
#: on both climate columns, 3 on discount, 4 on tax alone).
RECIPE_MODES = {
    "Full": ("1", "1", "1", "1"),
    "CoreGeo": ("1", "1", "0", "0"),
    "NoClimate": ("1", "1", "0", "0"),
    "M3_Broad": ("2", "2", "0", "0"),
    "M4_Spearman": ("CASE WHEN s_q THEN 2 ELSE 1 END", "CASE WHEN s_p THEN 2 ELSE 1 END", "0", "0"),
    "M4_GraphGuided": ("CASE WHEN g_q THEN 2 ELSE 1 END", "CASE WHEN g_p THEN 2 ELSE 1 END", "0", "0"),
    "M4_GraphUnion": ("CASE WHEN s_q OR g_q THEN 2 ELSE 1 END", "CASE WHEN s_p OR g_p THEN 2 ELSE 1 END", "0", "0"),
}
VIEW_MODES = {
    f"{view}/{how}": RECIPE_MODES[name] for view in linear.VIEWS for how, name in zip(linear.ADJUSTMENTS, ("NoClimate", "M3_Broad", "M4_Spearman"))
}
CONTROL_MODES = {
    "NoClimate": RECIPE_MODES["NoClimate"],
    "M4_Spearman": RECIPE_MODES["M4_Spearman"],
    "DropSelected": ("CASE WHEN s_q THEN 0 ELSE 1 END", "CASE WHEN s_p THEN 0 ELSE 1 END", "0", "0"),
    "SelectedRawOnly": ("CASE WHEN s_q THEN 1 ELSE 0 END", "CASE WHEN s_p THEN 1 ELSE 0 END", "0", "0"),
}


def models_sql(modes: dict[str, tuple[str, ...]], test: str = "SELECT 'original' AS scenario, b.fold AS tf, row_index, y, state, qty, price, disc, tax FROM b", choices: str = "se") -> str:
    """CTEs that end in of_(scenario, model, fold, row_index, y, state, p): the
    scores of the ``test`` rows by the ridge models of their folds."""
    modes_sql = " UNION ALL ".join(f"SELECT '{m}' AS model, tf, {q} AS k0, {p} AS k1, {d} AS k2, {t} AS k3 FROM {choices}" for m, (q, p, d, t) in modes.items())

    def made(src: str, keep: str) -> str:
        u, v = "(disc - a_disc) / s_disc", "(tax - a_tax) / s_tax"
        f0 = f"CASE k0 WHEN 1 THEN qty WHEN 2 THEN qty - a_qty - ({u}) * wq_u - ({v}) * wq_v WHEN 3 THEN qty - a_qty - ({u}) * oq_u WHEN 4 THEN qty - a_qty - ({v}) * oq_v ELSE 0 END"
        f1 = f"CASE k1 WHEN 1 THEN price WHEN 2 THEN price - a_price - ({u}) * wp_u - ({v}) * wp_v WHEN 3 THEN price - a_price - ({u}) * op_u WHEN 4 THEN price - a_price - ({v}) * op_v ELSE 0 END"
        return f"SELECT model, {keep}, {f0} AS f0, {f1} AS f1, CASE k2 WHEN 1 THEN disc ELSE 0 END AS f2, CASE k3 WHEN 1 THEN tax ELSE 0 END AS f3 FROM {src} x JOIN st USING (tf) JOIN cw USING (tf) JOIN cf USING (tf)"

    z = lambda i: f"(f{i} - b{i}) / CASE WHEN d{i} > 1e-9 THEN d{i} ELSE 1 END"
    cells = [f"sum(z{min(i, j)} * z{max(i, j)}){' + 10' if i == j else ''} AS g_{i}_{j}" for i in range(4) for j in range(4)] + [f"sum(z{i} * yc) AS g_{i}_4" for i in range(4)]
    return f"""cf AS ({modes_sql}), t1 AS ({made('fl', 'tf, y')}),
t2 AS (SELECT model, tf, avg(y) AS c_y, {', '.join(f'avg(f{i}) AS b{i}, stddev_pop(f{i}) AS d{i}' for i in range(4))} FROM t1 GROUP BY model, tf),
t3 AS (SELECT model, tf, y - c_y AS yc, {', '.join(f'{z(i)} AS z{i}' for i in range(4))} FROM t1 JOIN t2 USING (model, tf)),
t4 AS (SELECT model, tf, {', '.join(cells)} FROM t3 GROUP BY model, tf), {solved_sql('t4', 'model, tf', 4, 'tw')},
te AS ({test}), tg AS (SELECT scenario, te.tf, row_index, y, state, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)} FROM te JOIN md USING (tf)), th AS ({made('tg', 'tf, scenario, row_index, y, state')}),
of_ AS (SELECT scenario, model, tf AS fold, row_index, y, state, round(c_y + {' + '.join(f'w{i} * {z(i)}' for i in range(4))}, 9) AS p FROM th JOIN t2 USING (model, tf) JOIN tw USING (model, tf))"""


def metric_columns(names=METRICS) -> str:
    return ", ".join(r(m, m) for m in names)


def fitted(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, linear.FoldModels, dict, DataFrame]:
    """The rows, their fold models, sensitive columns and rank correlations."""
    rows = settled(samples(spark, sf_dir)) if rows is None else rows
    pairs = linear.ranked_pairs(rows, SETS["geochemistry"], SETS["climate_adjusters"])
    sensitive = linear.sensitive_by_fold(rows, SETS["geochemistry"], SETS["climate_adjusters"], SENSITIVE, pairs=pairs)
    return rows, linear.fit_folds(rows, list(FEATURES), "y"), sensitive, pairs


def scored(models: linear.FoldModels, rows: DataFrame) -> DataFrame:
    return models.score(rows, ["fold", "row_index", "y", "state"]).withColumn("p", F.round("p", 9))


def graphs(rows: DataFrame, sparse: bool = False, pairs: DataFrame | None = None) -> fold_graph.FoldGraphs:
    """The graphs of all folds' training rows; three zones are environments."""
    zoned = rows.withColumn("zone", F.col("state") % 3)
    return fold_graph.discover(zoned, FEATURES, "y", GROUPS, SETS["geochemistry"], SETS["climate_adjusters"], "zone", rules=GRAPH_RULES, sparse=sparse, pairs=pairs)


def all_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all seven recipes in every fold."""
    rows, models, sensitive, pairs = fitted(spark, sf_dir)
    return linear.metrics(linear.with_recipes(models, SETS, RECIPES, sensitive, graphs(rows, pairs=pairs).targets()), rows)


@query(f"WITH {GRAPH_BASE}, {models_sql(RECIPE_MODES, choices='se2')}, {metrics_sql('of_', 'model, fold')} SELECT model, fold, n_pos, n_neg, {metric_columns()} FROM mx")
def recipe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven recipes in every fold: screens, residuals, scales and scores
    of training rows only, and the metrics of the held-out ones."""
    m = all_recipes(spark, sf_dir)
    return rounded(m.select("model", "fold", "n_pos", "n_neg", *METRICS))


SHOWN = ("roc_auc", "average_precision", "balanced_accuracy")


def contrast_sql(src: str, base: str, candidate: str, name: str) -> str:
    """Rows of a paired contrast of two models of mx(model, fold, ...)."""
    of = lambda m, x: f"max(CASE WHEN model = '{x}' THEN {m} END)"
    one = " UNION ALL ".join(f"SELECT '{m}' AS metric, {of(m, candidate)} - {of(m, base)} AS d FROM {src} GROUP BY fold" for m in SHOWN)
    return f"""SELECT '{name}' AS contrast, metric, count(d) AS n_folds, {r('avg(d)', 'mean_delta')}, count(*) FILTER (d > 1e-12) AS better, count(*) FILTER (abs(d) <= 1e-12) AS equal, count(*) FILTER (d < -1e-12) AS worse FROM ({one}) GROUP BY metric"""


RECIPE_CONTRASTS = tuple((f"{c} - NoClimate", "NoClimate", c) for c in RECIPES if c != "NoClimate")
VIEW_CONTRASTS = (
    ("geochemistry: M4 - raw", "geochemistry_only/raw", "geochemistry_only/m4_spearman"),
    ("multimodal: M4 - raw", "multimodal_no_climate/raw", "multimodal_no_climate/m4_spearman"),
    ("raw: multimodal - geochemistry", "geochemistry_only/raw", "multimodal_no_climate/raw"),
    ("M4: multimodal - geochemistry", "geochemistry_only/m4_spearman", "multimodal_no_climate/m4_spearman"),
)


def contrasts(metrics: DataFrame, pairs) -> DataFrame:
    m = settled(metrics)
    parts = [evaluate.paired_contrast(m, ["fold"], "model", a, b, list(SHOWN)).withColumn("contrast", F.lit(n)) for n, a, b in pairs]
    return rounded(guards.union_all(parts))


@query(f"WITH {GRAPH_BASE}, {models_sql(RECIPE_MODES, choices='se2')}, {metrics_sql('of_', 'model, fold')} " + " UNION ALL ".join(contrast_sql("mx", a, b, n) for n, a, b in RECIPE_CONTRASTS))
def recipe_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recipe against the one without climate, fold by fold."""
    return contrasts(all_recipes(spark, sf_dir), RECIPE_CONTRASTS)


@query(
    f"""WITH {GRAPH_BASE} SELECT tf AS fold, 'qty' AS target, g_q AS selected FROM gt UNION ALL SELECT tf, 'price', g_p FROM gt"""
)
def fold_graph_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of the graph discovered in each fold's training rows."""
    fused = graphs(settled(samples(spark, sf_dir))).fused
    return fused.groupBy(F.col("test_fold").alias("fold"), "target").agg(F.bool_or("selected").alias("selected"))


@query(
    f"""WITH {GRAPH_BASE} SELECT tf AS fold, climate, target, {r('g', 'global_abs')}, {r('m', 'sensitive_rate')}, {r('c', 'causal_raw')} FROM gj"""
)
def fold_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three raw scores of every climate edge of each fold's graph."""
    fused = graphs(settled(samples(spark, sf_dir))).fused
    return rounded(fused.select(F.col("test_fold").alias("fold"), "climate", "target", "global_abs", "sensitive_rate", "causal_raw"))


@query()
def fold_graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's graph with the votes and edges of the sparse models too, in
    figures; tests hold these models against a plain solver."""
    return graphs(settled(samples(spark, sf_dir)), sparse=True).summary()


@query(f"WITH {BASE}, {models_sql(VIEW_MODES)}, {metrics_sql('of_', 'model, fold')} " + " UNION ALL ".join(contrast_sql("mx", a, b, n) for n, a, b in VIEW_CONTRASTS))
def matched_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts of views and adjustments on the same rows and folds."""
    rows, models, sensitive, pairs = fitted(spark, sf_dir)
    m = linear.metrics(linear.with_matched_views(models, SETS, sensitive), rows)
    return contrasts(m, VIEW_CONTRASTS)


#: Moved climate: discount by a tenth (no name of a temperature in it), tax too.
SCENARIO_ROWS = " UNION ALL ".join(
    f"SELECT '{s}' AS scenario, b.fold AS tf, row_index, y, state, qty, price, {d} AS disc, {t} AS tax FROM b"
    for s, d, t in (("original", "disc", "tax"), ("plus", "disc * 1.1::DOUBLE", "tax * 1.1::DOUBLE"), ("minus", "disc * 0.9::DOUBLE", "tax * 0.9::DOUBLE"), ("train_median", "NULL::DOUBLE", "NULL::DOUBLE"))
)


@query(
    f"""WITH {GRAPH_BASE}, {models_sql(RECIPE_MODES, SCENARIO_ROWS, 'se2')}, pv AS (SELECT model, fold, row_index, state, {', '.join(f"sum(p) FILTER (scenario = '{s}') AS {s}" for s in ('original', 'plus', 'minus', 'train_median'))} FROM of_ GROUP BY ALL),
d AS ({' UNION ALL '.join(f"SELECT model, fold, '{s}' AS scenario, {s} - original AS d FROM pv" for s in ('plus', 'minus', 'train_median'))})
SELECT model, fold, scenario, {r('avg(d)', 'mean_delta')}, {r('avg(abs(d))', 'mean_abs_delta')}, {r('median(abs(d))', 'median_abs_delta')}, {r('quantile_cont(abs(d), 0.95)', 'p95_abs_delta')}, {r('max(abs(d))', 'max_abs_delta')}, {r('avg((abs(d) > 0.05)::INT)', 'share_over_005')} FROM d GROUP BY model, fold, scenario"""
)
def recipe_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe fitted, its held-out rows' climate moved and scored again."""
    rows, models, sensitive, pairs = fitted(spark, sf_dir)
    linear.with_recipes(models, SETS, RECIPES, sensitive, graphs(rows, pairs=pairs).targets())
    return rounded(linear.perturbation(models, rows, ["row_index", "state"], SETS["climate_adjusters"]))


REPEATS = 100

def random_modes_sql() -> dict[str, tuple[str, ...]]:
    """Random controls that residualise one column, which (fold, repeat) tells."""
    pick = lambda i, on: f"CASE WHEN (tf + {i * i}) % 2 = {on} THEN 2 ELSE 1 END"
    return {f"RandomMatched/{i}": (pick(i, 0), pick(i, 1), "0", "0") for i in range(REPEATS)}


@query(
    f"""WITH {BASE}, {models_sql({**CONTROL_MODES, **random_modes_sql()})}, {metrics_sql('of_', 'model, fold')},
mm AS (SELECT model, avg(roc_auc) AS auc FROM mx GROUP BY model), ob AS (SELECT model, auc FROM mm WHERE model NOT LIKE 'Random%'), rd AS (SELECT auc FROM mm WHERE model LIKE 'Random%')
SELECT model, {r('ob.auc', 'observed')}, count(*) AS repeats, {r('avg(rd.auc)', 'control_mean')}, {r('quantile_cont(rd.auc, 0.95)', 'control_p95')}, {r('(1.0 + count(*) FILTER (round(rd.auc, 9) >= round(ob.auc, 9))) / (1.0 + count(*))', 'empirical_p')}, {r('avg((round(rd.auc, 9) < round(ob.auc, 9))::INT)', 'percentile')} FROM ob, rd GROUP BY model, ob.auc"""
)
def selection_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selection adds: models without it, with it, without what it
    takes and with that alone, beside random columns residualised instead."""
    rows, models, sensitive, pairs = fitted(spark, sf_dir)
    linear.with_recipes(models, SETS, list(CONTROL_MODES), sensitive)
    linear.with_random_controls(models, SETS, {(f, i): [("qty", "price")[(f + i * i) % 2]] for f in models.grams for i in range(REPEATS)})
    metrics = settled(linear.metrics(models, rows).groupBy("model").agg(F.avg("roc_auc").alias("auc")))
    control = metrics.where(F.col("model").startswith("Random")).select(F.round("auc", 9).alias("auc"))
    parts = [evaluate.random_control(control, metrics.where(F.col("model") == m).select(F.round("auc", 9).alias("auc")), "auc").withColumn("model", F.lit(m)) for m in CONTROL_MODES]
    return rounded(guards.union_all(parts))


SCHEME_SQL = """SELECT 'hard_only' AS scheme, row_index, y, fold, state, qty, price, disc, tax FROM b WHERE y = 1 OR state % 2 = 0
UNION ALL SELECT 'background_only', row_index, y, fold, state, qty, price, disc, tax FROM b WHERE y = 1 OR state % 2 = 1
UNION ALL SELECT 'mixed', row_index, y, fold, state, qty, price, disc, tax FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY y, fold, state % 2) AS n FROM b WINDOW w AS (PARTITION BY y, fold, state % 2 ORDER BY row_index * 31 % 10007, row_index, state, qty, tax)) WHERE y = 1 OR rn <= n // 2"""


def scheme_models_sql(schemes: str = SCHEME_SQL) -> str:
    """The recipes' SQL with every row set and statistic by scheme too."""
    base = BASE.replace(" b AS (SELECT row_index", " all_b AS (SELECT row_index")
    head, rest = base.split(",\ntr AS (", 1)
    schemes = schemes.replace("FROM b", "FROM all_b b")
    text = head + f",\nb AS (SELECT row_index, y, scheme || '/' || fold AS fold, state, qty, price, disc, tax, scheme, fold AS own FROM ({schemes})),\ntr AS (" + rest
    text = text.replace("(SELECT f.fold AS tf, b.* FROM b, (SELECT DISTINCT fold FROM b) f WHERE b.fold <> f.fold)", "(SELECT f.fold AS tf, b.* FROM b JOIN (SELECT DISTINCT fold, scheme FROM b) f ON b.scheme = f.scheme WHERE b.fold <> f.fold)")
    return text


@query(
    f"""WITH {scheme_models_sql()}, {models_sql({k: RECIPE_MODES[k] for k in ('NoClimate', 'M3_Broad')})}, {metrics_sql('of_', 'model, fold')}
SELECT model, split_part(fold, '/', 1) AS scheme, split_part(fold, '/', 2)::INT AS fold, n_pos, n_neg, {metric_columns(SHOWN)} FROM mx"""
)
def negative_source_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recipes under three sources of negative rows, each with folds,
    statistics and models of its own."""
    rows = settled(samples(spark, sf_dir))
    hard, back = rows.where("y = 0 and state % 2 = 0"), rows.where("y = 0 and state % 2 = 1")
    both = splits.negative_schemes(rows.where("y = 1"), hard, back, ["fold"], [F.col("row_index") * 31 % 10007, "row_index", "state", "qty", "tax"])
    parts = []
    for scheme in ("hard_only", "background_only", "mixed"):
        own = settled(both.where(F.col("scheme") == scheme))
        models = linear.fit_folds(own, list(FEATURES), "y")
        linear.with_recipes(models, SETS, ["NoClimate", "M3_Broad"], {})
        m = linear.metrics(models, own)
        parts.append(m.select("model", F.lit(scheme).alias("scheme"), "fold", "n_pos", "n_neg", *SHOWN))
    return rounded(guards.union_all(parts))


RATIOS = (5, 10, 20)
RATIO_ROWS = "(SELECT row_index, (y = 1 AND row_index % 8 = 7)::INT AS y, fold, state, qty, price, disc, tax FROM b) x"
RATIO_SQL = " UNION ALL ".join(
    f"""SELECT '{k}' AS scheme, row_index, y, fold, state, qty, price, disc, tax FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, y ORDER BY row_index * 31 % 10007, row_index, state, qty, tax) AS rn, sum(y) OVER (PARTITION BY fold) AS np FROM {RATIO_ROWS}) WHERE y = 1 OR rn <= {k} * np"""
    for k in RATIOS
)
RATIO_RECIPES = ("NoClimate", "M4_Spearman")


@query(
    f"""WITH {scheme_models_sql(RATIO_SQL)}, {models_sql({k: RECIPE_MODES[k] for k in RATIO_RECIPES})}, {metrics_sql('of_', 'model, fold')}
SELECT model, split_part(fold, '/', 1)::INT AS ratio, split_part(fold, '/', 2)::INT AS fold, n_pos, n_neg, {metric_columns(SHOWN)} FROM mx"""
)
def ratio_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recipes with five, ten and twenty negatives for every positive of a
    fold; returned seventh lines of an order are the rare positives."""
    rare = settled(samples(spark, sf_dir).withColumn("y", ((F.col("y") == 1) & (F.col("row_index") % 8 == 7)).cast("int")))
    parts = []
    own = rare
    for k in sorted(RATIOS, reverse=True):  # the first negatives are those of a larger ratio too
        own = settled(splits.with_ratio(own, "y", k, ["fold"], [F.col("row_index") * 31 % 10007, "row_index", "state", "qty", "tax"]))
        own, models, sensitive, _ = fitted(spark, sf_dir, own)
        linear.with_recipes(models, SETS, RATIO_RECIPES, sensitive)
        m = linear.metrics(models, own)
        parts.append(m.select("model", F.lit(k).alias("ratio"), "fold", "n_pos", "n_neg", *SHOWN))
    return rounded(guards.union_all(parts))


@query(
    f"""WITH {BASE}, sd AS (SELECT tf, stddev_pop(qty) AS dq, stddev_pop(price) AS dp, avg(qty) AS mq, avg(price) AS mp FROM fl GROUP BY tf),
z AS (SELECT tf, (qty - mq) / dq AS u, (price - mp) / dp AS v, disc - a_disc AS d, tax - a_tax AS t FROM fl JOIN sd USING (tf) JOIN st USING (tf)),
e AS (SELECT tf, sum(u * u) + 10 AS g_0_0, sum(u * v) AS g_0_1, sum(u * v) AS g_1_0, sum(v * v) + 10 AS g_1_1, sum(u * d) AS hd0, sum(v * d) AS hd1, sum(u * t) AS ht0, sum(v * t) AS ht1 FROM z GROUP BY tf),
ed AS (SELECT tf, g_0_0, g_0_1, g_1_0, g_1_1, hd0 AS g_0_2, hd1 AS g_1_2 FROM e), et AS (SELECT tf, g_0_0, g_0_1, g_1_0, g_1_1, ht0 AS g_0_2, ht1 AS g_1_2 FROM e), {solved_sql('ed', 'tf', 2, 'wd')}, {solved_sql('et', 'tf', 2, 'wt')},
te AS (SELECT b.fold AS tf, (coalesce(qty, m_qty) - mq) / dq AS u, (coalesce(price, m_price) - mp) / dp AS v, coalesce(disc, m_disc) AS d, coalesce(tax, m_tax) AS t FROM b JOIN md ON b.fold = md.tf JOIN sd ON b.fold = sd.tf),
fo AS (SELECT te.tf, d, t, round(a_disc + u * wd.w0 + v * wd.w1, 9) AS pd, round(a_tax + u * wt.w0 + v * wt.w1, 9) AS pt FROM te JOIN st ON te.tf = st.tf JOIN wd ON te.tf = wd.tf JOIN wt ON te.tf = wt.tf),
ro AS (SELECT *, {', '.join(f"rank() OVER (PARTITION BY tf ORDER BY {c}) + (count(*) OVER (PARTITION BY tf, {c}) - 1) / 2.0 AS r_{c}" for c in ('d', 't', 'pd', 'pt'))} FROM fo),
ss AS (SELECT tf AS fold, sum(pow(d - pd, 2)) + sum(pow(t - pt, 2)) AS sse, var_pop(d) * count(*) + var_pop(t) * count(*) AS sst, (corr(r_d, r_pd) + corr(r_t, r_pt)) / 2 AS rho FROM ro GROUP BY tf)
SELECT fold, {r('1 - sse / sst', 'r2')}, {r('rho', 'mean_spearman')} FROM ss"""
)
def held_out_predictability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the climate columns are foretold by the others in held-out folds."""
    return rounded(linear.held_out_predictability(settled(samples(spark, sf_dir)), ["qty", "price"], ["disc", "tax"]))


GAMMAS = (0.0, 0.5, 1.0, 2.0)


@query(
    f"""WITH {ITEMS}, md AS (SELECT median(disc) AS md FROM it), f AS (SELECT price::DOUBLE AS x, coalesce(disc, md)::DOUBLE AS d, tax::DOUBLE AS t, row_index FROM it, md), s AS (SELECT avg(d) AS ad, stddev_pop(d) AS sd, avg(t) AS at_, stddev_pop(t) AS st, stddev_pop(x) AS sx, corr(d, t) AS rho, median(x) AS mx, count(*) AS n FROM f),
c AS (SELECT x, (d - ad) / sd AS u, (t - at_) / st AS v, ((d - ad) / sd + CASE WHEN rho >= 0 THEN 1 ELSE -1 END * (t - at_) / st) / sqrt(2.0) / sqrt(1 + abs(rho)) AS pc, sx, mx FROM f, s),
g AS (SELECT g, coalesce(x, mx) AS x0, coalesce(x + g * sx * pc, mxg) AS x1, x, u, v, pc, sx FROM (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS g) gs, c, (SELECT g2, median(x + g2 * sx * pc) AS mxg FROM c, (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS g2) GROUP BY g2) mg WHERE mg.g2 = gs.g),
a AS (SELECT g, avg(x0) AS a0, avg(x1) AS a1 FROM g GROUP BY g),
k AS (SELECT g, sum(u * u) + 10 AS uu, sum(v * v) + 10 AS vv, sum(u * v) AS uv, sum(u * (x0 - a0)) AS u0, sum(v * (x0 - a0)) AS v0, sum(u * (x1 - a1)) AS u1, sum(v * (x1 - a1)) AS v1 FROM g JOIN a USING (g) GROUP BY g),
w AS (SELECT g, (u0 * vv - v0 * uv) / (uu * vv - uv * uv) AS p0, (v0 * uu - u0 * uv) / (uu * vv - uv * uv) AS q0, (u1 * vv - v1 * uv) / (uu * vv - uv * uv) AS p1, (v1 * uu - u1 * uv) / (uu * vv - uv * uv) AS q1 FROM k)
SELECT g AS gamma, {r('sqrt(avg(pow(g.g * pc, 2)) FILTER (x IS NOT NULL))', 'raw_rmse')}, {r('sqrt(avg(pow(((x1 - a1 - u * p1 - v * q1) - (x0 - a0 - u * p0 - v * q0)) / sx, 2)))', 'recovered_rmse')} FROM g JOIN a USING (g) JOIN w USING (g) GROUP BY g"""
)
def contamination_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the first component of two climate columns added to a
    feature, and what residuals leave of it."""
    it = settled(samples(spark, sf_dir))
    score = stats.ClimateScore(["disc", "tax"]).fit(it)
    sd = float(it.agg(F.stddev_pop("price")).first()[0])
    made = it.withColumns({f"x{i}": stats.contaminated("price", F.lit(sd), score.score(), g) for i, g in enumerate(GAMMAS)})
    names = ["price", *[f"x{i}" for i in range(len(GAMMAS))]]
    clean = stats.Residualizer(names, ["disc", "tax"]).fit(made).transform(made)
    of = lambda a, b: stats.standardized_rmse([(F.col(a), F.col(b), F.lit(sd))])
    sums = clean.agg(*[c for i in range(len(GAMMAS)) for c in (of(f"x{i}", "price").alias(f"a{i}"), of(f"x{i}_climate_resid", "price_climate_resid").alias(f"b{i}"))])
    return rounded(sums.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gamma"), F.col(f"a{i}").alias("raw_rmse"), F.col(f"b{i}").alias("recovered_rmse")) for i, g in enumerate(GAMMAS)]))))


SPREAD_MODES = {k: RECIPE_MODES[k] for k in ("NoClimate", "M3_Broad")}


def spread_sql() -> str:
    """The recipes' SQL with quantity contaminated at each strength: the
    filled rows and what follows from them by fold/strength."""
    shifted = "qty + g * s_qty * ((disc - a_disc) / s_disc + CASE WHEN rho >= 0 THEN 1 ELSE -1 END * (tax - a_tax) / s_tax) / sqrt(2.0) / sqrt(1 + abs(rho)) AS qty, price, disc, tax"
    tail = BASE[BASE.index("st AS (") : BASE.index("pr AS (")].rstrip().rstrip(",")
    for name in ("st", "cg", "cw"):
        tail = tail.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"JOIN {name} ", f"JOIN {name}2 ")
    test = "SELECT 'original' AS scenario, tf || '/' || g AS tf, row_index, y, state, " + shifted + " FROM tq"
    models = models_sql(SPREAD_MODES, test, "s2")
    for a, b in (("FROM fl x", "FROM fl2 x"), ("JOIN st ", "JOIN st2 "), ("JOIN cw ", "JOIN cw2 "), ("JOIN md ", "JOIN md2 ")):
        models = models.replace(a, b)
    return f"""{BASE}, gm2 AS (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS g), rh AS (SELECT tf, corr(disc, tax) AS rho FROM fl GROUP BY tf),
fl2 AS (SELECT tf || '/' || g AS tf, y, {shifted} FROM fl JOIN st USING (tf) JOIN rh USING (tf), gm2), {tail.replace('FROM fl ', 'FROM fl2 ')},
md2 AS (SELECT tf || '/' || g AS tf, {', '.join(f'm_{c}' for c in FEATURES)} FROM md, gm2), s2 AS (SELECT DISTINCT tf FROM fl2),
tq AS (SELECT b.fold AS tf, row_index, y, state, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)}, {', '.join(f'a_{c}, s_{c}' for c in FEATURES)}, rho, g FROM b JOIN md ON md.tf = b.fold JOIN st ON st.tf = b.fold JOIN rh ON rh.tf = b.fold, gm2), {models}"""


@query(
    f"""WITH {spread_sql()}, {metrics_sql('of_', 'model, fold')},
rr AS (SELECT q.tf || '/' || q.g AS fold, q.qty AS clean, q.s_qty, {'x.' + 'qty AS raw, '}x.qty - t.a_qty - (x.disc - t.a_disc) / t.s_disc * wq_u - (x.tax - t.a_tax) / t.s_tax * wq_v AS resid
  FROM (SELECT *, row_number() OVER (ORDER BY tf, g, row_index, state, qty, price, disc, tax) AS rn FROM tq) q JOIN (SELECT *, row_number() OVER (ORDER BY tf, g, row_index, state, clean, price, disc, tax) AS rn FROM (SELECT tf, g, row_index, state, qty AS clean, qty + g * s_qty * ((disc - a_disc) / s_disc + CASE WHEN rho >= 0 THEN 1 ELSE -1 END * (tax - a_tax) / s_tax) / sqrt(2.0) / sqrt(1 + abs(rho)) AS qty, price, disc, tax FROM tq)) x USING (rn)
  JOIN st2 t ON t.tf = q.tf || '/' || q.g JOIN cw2 w ON w.tf = t.tf),
rv AS (SELECT fold, sqrt(avg(pow((raw - clean) / s_qty, 2))) AS raw, sqrt(avg(pow((resid - clean) / s_qty, 2))) AS resid FROM rr GROUP BY fold)
SELECT split_part(mx.fold, '/', 2)::DOUBLE AS gamma, model, split_part(mx.fold, '/', 1)::INT AS fold, {metric_columns(SHOWN)}, round(CASE WHEN model = 'M3_Broad' THEN resid ELSE raw END, 6) + 0.0 AS recovery FROM mx JOIN rv USING (fold)"""
)
def contaminated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recipes with quantity, which lacks no value, contaminated by the
    climate score at four strengths, and how far it is from the clean one in
    the held-out rows; every strength from one table of products."""
    rows, models, *_ = fitted(spark, sf_dir)
    sets = {"NoClimate": (["qty", "price"], []), "M3_Broad": ([], ["qty", "price"])}
    told = linear.contamination(models, linear.own_grams(rows, models), ["qty"], SETS["climate_adjusters"], GAMMAS, sets)
    m = linear.metrics(models, rows)
    part = lambda i: F.split("model", "/")[i]
    m = m.select(part(0).alias("model"), part(1).cast("double").alias("gamma"), "fold", *SHOWN)
    found = spark.createDataFrame([(g, n, f, a) for g, n, f, a, _, _ in told], f"gamma double, model string, fold {dict(rows.dtypes)['fold']}, recovery double")
    return rounded(m.join(F.broadcast(found), ["gamma", "model", "fold"]).select("gamma", "model", "fold", *SHOWN, "recovery"))


@query(
    f"""WITH {GRAPH_BASE}, {models_sql({k: RECIPE_MODES[k] for k in ('NoClimate', 'M4_GraphGuided')}, choices='se2')}, {metrics_sql('of_', 'model, fold')}, d AS (
  SELECT fold, max(CASE WHEN model = 'M4_GraphGuided' THEN roc_auc END) - max(CASE WHEN model = 'NoClimate' THEN roc_auc END) AS d FROM mx GROUP BY fold),
dr AS (SELECT i, (i * i * 7 + k * k * (i + 3) + k * 5 + i) % 101 % 5 AS fold FROM range(10000) a(i), range(5) b(k)), m AS (SELECT i, avg(d) AS m FROM dr JOIN d USING (fold) GROUP BY i)
SELECT {r('avg(m)', 'mean_delta')}, {r('quantile_cont(m, 0.025)', 'low')}, {r('quantile_cont(m, 0.975)', 'high')} FROM m"""
)
def replayed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run replayed with a frozen graph: its folds must be those of the
    frozen table, row by row, and the fold differences are resampled."""
    rows, models, *_ = fitted(spark, sf_dir)
    frozen = rows.select(F.col("fold").alias("frozen_fold"), F.col("fold")).distinct()
    guards.expect_same_rows(splits.frozen_folds(rows, frozen, ["fold"]).select("row_index", "state", F.col("frozen_fold").alias("fold")), rows.select("row_index", "state", "fold"))
    written = settled(graphs(rows).fused.where("selected").select("test_fold", "target").distinct())  # the frozen graph, read again
    frozen_graph: dict = {}
    for g in written.collect():  # folds x columns
        frozen_graph.setdefault(g["test_fold"], set()).add(g["target"])
    linear.with_recipes(models, SETS, ["NoClimate", "M4_GraphGuided"], {}, frozen_graph)
    m = linear.metrics(models, rows)
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("roc_auc")))
    deltas = m.groupBy("fold").agg((of("M4_GraphGuided") - of("NoClimate")).alias("delta"))
    i, k = F.col("iteration"), F.col("k")
    grid = spark.range(10_000).select(F.col("id").alias("iteration"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    times = grid.groupBy("iteration", ((i * i * 7 + k * k * (i + 3) + k * 5 + i) % 101 % 5).cast("int").alias("fold")).agg(F.count("*").alias("times"))
    return rounded(evaluate.fold_bootstrap(deltas, times))


@query(
    f"""WITH {BASE}, {models_sql({'NoClimate': RECIPE_MODES['NoClimate']})}, tk AS (SELECT fold, y, state, row_number() OVER (PARTITION BY fold ORDER BY p DESC, row_index, state) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM of_),
t AS (SELECT fold, y, state, rn <= greatest(1, ceil(n * 0.1::DOUBLE)) AS top FROM tk), f AS (
  SELECT fold, count(*) FILTER (top) AS candidate_rows, count(*) FILTER (top AND y = 1) AS positive_rows, count(DISTINCT state) FILTER (top AND y = 1) AS clusters_hit, count(DISTINCT state) FILTER (y = 1) AS clusters FROM t GROUP BY fold)
SELECT sum(candidate_rows)::BIGINT AS candidate_rows, sum(positive_rows)::BIGINT AS positive_rows, sum(clusters_hit)::BIGINT AS clusters_hit, sum(clusters)::BIGINT AS clusters, {r('sum(clusters_hit) / sum(clusters)', 'cluster_recall')}, {r('sum(clusters_hit) / sum(candidate_rows)', 'cluster_precision')}, {r('avg(clusters_hit / clusters)', 'mean_cluster_recall')} FROM f"""
)
def pooled_foldwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters among the top tenth of each fold: ratios of sums over folds,
    beside the mean of the folds' own ratios."""
    rows, models, *_ = fitted(spark, sf_dir)
    linear.with_recipes(models, SETS, ["NoClimate"], {})
    top = evaluate.distinct_top(scored(models, rows).withColumn("o", F.struct("row_index", "state")), ["fold"], "state", 0.1, order="o")
    sums = ("candidate_rows", "positive_rows", "clusters_hit", "clusters")
    out = evaluate.pooled_foldwise(top, [], sums, {"cluster_recall": ("clusters_hit", "clusters"), "cluster_precision": ("clusters_hit", "candidate_rows")})
    return rounded(out.crossJoin(top.agg(F.avg("cluster_recall").alias("mean_cluster_recall"))))


CONCEPT_ROWS = f"""{Z_SQL}, b AS (SELECT row_index, y, env AS fold, state, greatest(qty_z, price_z) AS qty, price_z AS price, -disc_z AS disc, list_median(list_filter([disc_z, tax_z], lambda x: x IS NOT NULL)) AS tax FROM zs)"""
CONCEPT_MODES = {"M1": ("1", "1", "1", "1"), "M2": RECIPE_MODES["NoClimate"], "M3": RECIPE_MODES["M3_Broad"], "M4": RECIPE_MODES["M4_Spearman"]}


@query(f"WITH {folds_sql(CONCEPT_ROWS)}, {models_sql(CONCEPT_MODES)}, {metrics_sql('of_', 'model, fold')} SELECT model, fold, n_pos, n_neg, {metric_columns(SHOWN)} FROM mx")
def concept_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M4 on concepts (row maxima and medians of scaled features)."""
    z = stats.with_robust_z(items(spark, sf_dir), Z_COLUMNS)
    concepts = (
        {"concept": "qty", "features": ["qty", "price"], "role": "pathfinder_signal"},
        {"concept": "price", "features": ["price"], "role": "pathfinder_signal"},
        {"concept": "disc", "features": ["disc"], "role": "context", "reverse": ["disc"]},
        {"concept": "tax", "features": ["disc", "tax"], "role": "context"},
    )
    cols = catalog.concept_columns(concepts, {c: F.col(f"{c}_z") for c in Z_COLUMNS}, {})
    rows = settled(z.select("row_index", "y", F.col("env").alias("fold"), "state", *[c.alias(k) for k, c in cols.items()]))
    models, sensitive = linear.fit_folds(rows, list(FEATURES), "y"), linear.sensitive_by_fold(rows, SETS["geochemistry"], SETS["climate_adjusters"], SENSITIVE)
    for name, recipe_name in (("M1", "Full"), ("M2", "NoClimate"), ("M3", "M3_Broad"), ("M4", "M4_Spearman")):
        before = len(models.solved)
        linear.with_recipes(models, SETS, [recipe_name], sensitive)
        models.solved[before:] = [(name, *rest) for _, *rest in models.solved[before:]]
    m = linear.metrics(models, rows)
    return rounded(m.select("model", "fold", "n_pos", "n_neg", *SHOWN))


def chosen(x: str, mode: int) -> tuple[str, str, str, str]:
    return (f"CASE WHEN s_q{x} THEN {mode} ELSE 1 END", f"CASE WHEN s_p{x} THEN {mode} ELSE 1 END", "0", "0")


#: Discount stands for today's climate, tax for another age's.
CLIMATE_MODES = {
    "m1_modern_full": ("1", "1", "1", "0"),
    "m1_modern_plus_other": ("1", "1", "1", "1"),
    "m2_no_climate": ("1", "1", "0", "0"),
    "m4_modern": chosen("_d", 3),
    "m4_other": chosen("_t", 4),
    "m4_both": chosen("", 2),
}
CLIMATE_CONTRASTS = (
    ("modern", "m2_no_climate", "m4_modern"),
    ("other", "m2_no_climate", "m4_other"),
    ("both", "m2_no_climate", "m4_both"),
    ("other - modern", "m4_modern", "m4_other"),
    ("raw other", "m1_modern_full", "m1_modern_plus_other"),
)


def with_climate_sets(models: linear.FoldModels, rows: DataFrame, pairs: DataFrame) -> linear.FoldModels:
    sets = {"m4_modern": ["disc"], "m4_other": ["tax"], "m4_both": ["disc", "tax"]}
    found = {k: linear.sensitive_by_fold(rows, SETS["geochemistry"], c, SENSITIVE, pairs=pairs) for k, c in sets.items()}
    for f in models.grams:
        models.add("m1_modern_full", f, ["qty", "price", "disc"])
        models.add("m1_modern_plus_other", f, list(FEATURES))
        models.add("m2_no_climate", f, ["qty", "price"])
        for k, c in sets.items():
            s = found[k].get(f, set())
            models.add(k, f, [x for x in ("qty", "price") if x not in s], [x for x in ("qty", "price") if x in s], c)
    return models


@query(f"WITH {BASE}, {models_sql(CLIMATE_MODES)}, {metrics_sql('of_', 'model, fold')} " + " UNION ALL ".join(contrast_sql("mx", a, b, n) for n, a, b in CLIMATE_CONTRASTS))
def climate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models adjusted for one set of climate columns, another, or both."""
    rows, models, _, pairs = fitted(spark, sf_dir)
    return contrasts(linear.metrics(with_climate_sets(models, rows, pairs), rows), CLIMATE_CONTRASTS)


#: Customers with the mean of a band of cells, by the nearest cell that holds
#: them, over half a year of events.
ALIGNED_ROWS = f"""{POINTS}, cl AS (SELECT i * 100 + j AS cell, 31.25 + i * 0.5 AS lat, -124.75 + j * 0.5 AS lon FROM range(36) a(i), range(46) b(j)),
gd AS (SELECT p.id, c.cell, abs(p.lat - c.lat) <= 0.250001 AND abs(p.lon - c.lon) <= 0.250001 AS inside, row_number() OVER (PARTITION BY p.id ORDER BY round(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2), 9), c.cell) AS nth FROM pt p, cl c WHERE abs(p.lat - c.lat) < 2.5 AND abs(p.lon - c.lon) < 2.5),
bv AS (SELECT user_id % 36 AS band, avg(value) AS mean FROM events WHERE dayofyear(ts) BETWEEN 1 AND 180 GROUP BY band),
b AS (SELECT pt.id AS row_index, y, (state % 5)::INT AS fold, state, bal::DOUBLE AS qty, (pt.id % 53)::DOUBLE AS price, pt.lon AS disc, mean::DOUBLE AS tax FROM pt JOIN gd ON gd.id = pt.id AND nth = 1 AND inside JOIN bv ON band = cell // 100 WHERE mean IS NOT NULL)"""


@query(f"WITH {folds_sql(ALIGNED_ROWS)}, {models_sql(CLIMATE_MODES)}, {metrics_sql('of_', 'model, fold')} SELECT model, fold, n_pos, n_neg, {metric_columns(SHOWN)} FROM mx")
def aligned_climate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of samples aligned with a grid: each takes the past climate of
    the cell that holds it, a mean over a window of the cells' series; those
    without one are left out. Today's climate, the past one, or both adjust."""
    pt = points(spark, sf_dir)
    steps = lambda n: spark.range(n).select(F.col("id"))
    cells = steps(36).select(F.col("id").alias("i")).crossJoin(F.broadcast(steps(46).select(F.col("id").alias("j"))))  # a grid of fixed size
    cells = cells.select((F.col("i") * 100 + F.col("j")).alias("cell"), (31.25 + F.col("i") * 0.5).alias("lat"), (-124.75 + F.col("j") * 0.5).alias("lon"))
    placed = spatial.grid_cell(pt, cells, "id").where("in_cell").select(F.col("id").alias("_id"), F.floor(F.col("cell") / 100).alias("band"))
    values = table(spark, sf_dir, "events").select((F.col("user_id") % 36).alias("band"), F.dayofyear("ts").alias("year"), "value")
    past = series.period_summary(values, [(1, 180)], by=("band",)).where("mean is not null").select("band", F.col("mean").alias("tax"))
    aligned = pt.join(placed, pt["id"] == placed["_id"]).join(F.broadcast(past), "band")  # a row for each band
    named = {"qty": F.col("bal").cast("double"), "price": (F.col("id") % 53).cast("double"), "disc": F.col("lon"), "tax": F.col("tax")}
    rows = settled(aligned.select(F.col("id").alias("row_index"), "y", (F.col("state") % 5).cast("int").alias("fold"), "state", *[c.alias(k) for k, c in named.items()]))
    rows, models, _, pairs = fitted(spark, sf_dir, rows)
    m = linear.metrics(with_climate_sets(models, rows, pairs), rows)
    return rounded(m.select("model", "fold", "n_pos", "n_neg", *SHOWN))


#: The tax is a block of further features, discount the climate.
ENHANCED_MODES = {f"{m}{plus}": (q, p, "0", "1" if plus else "0") for m, (q, p) in {"M2": ("1", "1"), "M3": ("3", "3"), "M4": chosen("_d", 3)[:2]}.items() for plus in ("", "+block")}
ENHANCED_CONTRASTS = tuple((f"{m}: block", m, f"{m}+block") for m in ("M2", "M3", "M4")) + (("M4 - M2 with block", "M2+block", "M4+block"),)


@query(f"WITH {BASE}, {models_sql(ENHANCED_MODES)}, {metrics_sql('of_', 'model, fold')} " + " UNION ALL ".join(contrast_sql("mx", a, b, n) for n, a, b in ENHANCED_CONTRASTS))
def enhanced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a further block of features adds to M2, M3 and M4, in folds of a
    published table that every row must find."""
    rows = settled(samples(spark, sf_dir))
    published = rows.select("state", F.col("fold").alias("_published")).distinct()
    rows = settled(splits.frozen_folds(rows.drop("fold"), published, ["state"]).withColumnRenamed("_published", "fold"))
    models, s = linear.fit_folds(rows, list(FEATURES), "y"), linear.sensitive_by_fold(rows, SETS["geochemistry"], ["disc"], SENSITIVE)
    for f in models.grams:
        for m, taken in (("M2", set()), ("M3", {"qty", "price"}), ("M4", s.get(f, set()))):
            for plus in ("", "+block"):
                models.add(m + plus, f, [x for x in ("qty", "price") if x not in taken] + (["tax"] if plus else []), [x for x in ("qty", "price") if x in taken], ["disc"])
    return contrasts(linear.metrics(models, rows), ENHANCED_CONTRASTS)


def block_rows_sql(degrees: int) -> str:
    return f"""{POINTS}, pb AS (SELECT id AS row_index, y, state, '{degrees}deg_' || floor((lon + 180) / {degrees})::BIGINT || '_' || floor((lat + 90) / {degrees})::BIGINT AS g, bal AS qty, lat AS price, lon AS disc, (id % 53)::DOUBLE AS tax FROM pt),
bg AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g DESC) AS k FROM pb GROUP BY g),
lpt(k, g, fold, load) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::INT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT bg.k, bg.g, (list_position(load, list_min(load)) - 1)::INT, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + bg.n ELSE x END) FROM lpt JOIN bg ON bg.k = lpt.k + 1
), b AS (SELECT row_index, y, fold, state, qty::DOUBLE AS qty, price, disc, tax FROM pb JOIN lpt USING (g))"""


BLOCK_RECIPES = ("NoClimate", "M3_Broad", "M4_Spearman", "M4_GraphUnion")


def block_sql(degrees: int) -> str:
    modes = {k: RECIPE_MODES[k] for k in BLOCK_RECIPES}
    return f"SELECT * FROM (WITH RECURSIVE {folds_sql(block_rows_sql(degrees))}, {graph_sql()}, {models_sql(modes, choices='se2')}, {metrics_sql('of_', 'model, fold')} SELECT {degrees} AS degrees, model, fold, n_pos, n_neg, {metric_columns(SHOWN)} FROM mx)"


@query(block_sql(2) + " UNION ALL " + block_sql(3))
def block_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four recipes in folds that split no grid block, of two widths, with
    screens and graphs of each fold's own training rows."""
    parts = []
    for degrees in (2, 3):
        pt = points(spark, sf_dir).withColumn("block", spatial.block_id(F.col("lon"), F.col("lat"), degrees))
        folds = splits.group_kfold(pt, "block", 5)
        named = {"qty": F.col("bal").cast("double"), "price": F.col("lat"), "disc": F.col("lon"), "tax": (F.col("id") % 53).cast("double")}
        rows = settled(folds.select(F.col("id").alias("row_index"), "y", "fold", "state", *[c.alias(k) for k, c in named.items()]))
        rows, models, sensitive, pairs = fitted(spark, sf_dir, rows)
        linear.with_recipes(models, SETS, BLOCK_RECIPES, sensitive, graphs(rows, pairs=pairs).targets())
        m = linear.metrics(models, rows)
        parts.append(m.select(F.lit(degrees).alias("degrees"), "model", "fold", "n_pos", "n_neg", *SHOWN))
    return rounded(guards.union_all(parts))


RADII = (10, 20, 30)
BUFFER_ROWS = f"""{POINTS}, b AS (SELECT id AS row_index, y, (state % 5)::VARCHAR AS fold, state, bal::DOUBLE AS qty, lat AS price, lon AS disc, (id % 53)::DOUBLE AS tax, lat, lon FROM pt),
rad AS (SELECT unnest([0, {', '.join(map(str, RADII))}]) AS km), nd AS (SELECT a.row_index, o.fold AS other, min({km_sql('a', 'o')}) AS d FROM b a JOIN b o ON a.fold <> o.fold AND abs(a.lat - o.lat) < 0.3 GROUP BY a.row_index, o.fold)"""
BUFFER_SQL = folds_sql(BUFFER_ROWS).replace(
    "(SELECT f.fold AS tf, b.* FROM b, (SELECT DISTINCT fold FROM b) f WHERE b.fold <> f.fold)",
    "(SELECT f.fold || '/' || km AS tf, b.* FROM b CROSS JOIN (SELECT DISTINCT fold FROM b) f CROSS JOIN rad LEFT JOIN nd ON nd.row_index = b.row_index AND nd.other = f.fold WHERE b.fold <> f.fold AND (km = 0 OR coalesce(d, 1e9) > km))",
)


def folded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a place as samples, in five folds of states."""
    named = {"qty": F.col("bal").cast("double"), "price": F.col("lat"), "disc": F.col("lon"), "tax": (F.col("id") % 53).cast("double")}
    return points(spark, sf_dir).select(F.col("id").alias("row_index"), "y", (F.col("state") % 5).cast("int").alias("fold"), "state", "lat", "lon", *[c.alias(k) for k, c in named.items()])


@query(
    f"""WITH {BUFFER_SQL}, {models_sql({k: RECIPE_MODES[k] for k in ('Full', 'NoClimate', 'M3_Broad')}, "SELECT 'original' AS scenario, b.fold || '/' || km AS tf, row_index, y, state, qty, price, disc, tax FROM b, rad")}, {metrics_sql('of_', 'model, fold')},
nt AS (SELECT tf AS fold, count(*) AS n_train FROM tr GROUP BY tf)
SELECT model, split_part(fold, '/', 1)::INT AS fold, split_part(fold, '/', 2)::INT AS km, n_train, n_pos, n_neg, {metric_columns(SHOWN)} FROM mx JOIN nt USING (fold)"""
)
def buffer_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recipes with the training rows near the test fold left out, by
    buffers of none to 30 km, all from one table of products by distance."""
    rows = settled(folded_rows(spark, sf_dir))
    models = linear.fit_buffered(rows, list(FEATURES), "y", "row_index", RADII)
    linear.with_recipes(models, SETS, ["Full", "NoClimate", "M3_Broad"], {})
    m = linear.metrics(models, linear.at_radii(rows, RADII))
    sizes = spark.createDataFrame([(f, int(g.n)) for f, g in models.grams.items()], "fold string, n_train long")
    part = lambda i: F.split("fold", "/")[i].cast("int")
    return rounded(m.join(F.broadcast(sizes), "fold").select("model", part(0).alias("fold"), part(1).alias("km"), "n_train", "n_pos", "n_neg", *SHOWN))


@query()
def boosted_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted learner on all seven recipes in all folds, with all of its
    400 trees. Trees are beyond SQL; tests hold them against a plain version."""
    rows, models, sensitive, pairs = fitted(spark, sf_dir)
    found = graphs(rows, pairs=pairs).targets()
    columns = {n: {f: recipe.columns_of(n, SETS, sensitive.get(f, set()), found.get(f, set())) for f in models.grams} for n in RECIPES}
    keyed = rows.withColumn("row", F.xxhash64("row_index", "state", "qty", "price", "disc", "tax"))
    scores = boosting.boost(models, keyed, "row", columns, SETS["climate_adjusters"])
    m = evaluate.classification_metrics(scores.withColumn("p", F.round("p", 9)), ["model", "fold"])
    return rounded(m.select("model", "fold", "n_pos", "n_neg", *METRICS))


@query()
def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four plain learners in stratified and in grouped folds: a dummy, a
    logistic model with a ridge, boosted trees and a forest. Trees are few (8
    of 200, 20 of 300), and beyond SQL; tests hold the learners against plain
    versions, coverage and the dummy's rate."""
    features = ["lat", "lon", "bal"]
    pt = points(spark, sf_dir).select("id", "y", "state", "lat", "lon", F.col("bal").cast("double").alias("bal"))
    schemes = {"stratified": splits.stratified_kfold(pt, "y", [F.col("id") * 7919 % 10007, "id"], splits.usable_splits(pt, "y")), "grouped": splits.group_kfold(pt, "state", 5)}
    parts = []
    for name, rows in schemes.items():
        rows = settled(rows)
        plain = experiments.baselines(rows, features, "y", "id", ("dummy", "forest"), trees=20)
        linear_ = logistic.score_folds(logistic.fit_all(rows, features, "y", "fold", penalty="l2"), rows, "fold", ["fold", F.col("y").cast("int").alias("y")])
        models = linear.fit_folds(rows, features, "y")
        trees = boosting.boost(models, rows, "id", {"hist_boosted": {f: (features, []) for f in models.grams}}, [], boosting.Settings(trees=8, rate=0.05, depth=4, rows=1.0, columns=1.0, ridge=0.0, least_weight=1e-3))
        scores = trees.select("model", "fold", "y", "p").unionByName(linear_.select(F.lit("logistic_l2").alias("model"), "fold", "y", "p"))
        parts += [p.withColumn("cv", F.lit(name)) for p in (plain, evaluate.classification_metrics(scores, ["model", "fold"]))]
    return rounded(guards.union_all(parts))
