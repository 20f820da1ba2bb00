"""One query for each operator, on the driver's tables, with DuckDB SQL.

The tables have no coordinates, climate or deposits, so each operator runs on
a stand-in: line items are samples (label: returned), regions environments,
nations states; customers get coordinates by arithmetic on their key. Nulls
are injected by arithmetic too, so that both engines see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.lineage import settled
from .operators import catalog, evaluate, graph, guards, series, spatial, splits, stats
from .plans import experiments, learners, linear, logistic, recipe
from .plans import forest as forest_of_cells
from .sources import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


#: Suppliers that are sent to the items, at most.
MOST_PLACES = 1_000_000


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples: row_index (repeated where the table repeats an
    order's line), label y, four features, env, state."""
    li, su, na = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    places = su.join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("env"), F.col("s_nationkey").alias("state"))
    # a join's guessed size is a product, so that every scan would shuffle the items for a few suppliers; a small table is dealt to all cores by that shuffle
    if li.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and su.count() <= MOST_PLACES:
        places = F.broadcast(places)
    return li.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_index"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("disc"),
        F.col("l_tax").alias("tax"),
        "env",
        "state",
    )


ITEMS = """
it AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_index, (l_returnflag = 'R')::INT AS y, l_quantity AS qty,
         CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS price,
         CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS disc, l_tax AS tax,
         n_regionkey AS env, s_nationkey AS state
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (31 + (k * 37 % 1800) / 100.0).alias("lat"), (-125 + (k * 91 % 2300) / 100.0).alias("lon"), F.col("c_nationkey").alias("state"), (F.col("c_acctbal") > 5000).cast("int").alias("y"),
        F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"),
    )


POINTS = """
pt AS (
  SELECT c_custkey AS id, 31 + (c_custkey * 37 % 1800) / 100.0::DOUBLE AS lat, -125 + (c_custkey * 91 % 2300) / 100.0::DOUBLE AS lon,
         c_nationkey AS state, (c_acctbal > 5000)::INT AS y, c_acctbal AS bal, c_mktsegment AS segment, c_name AS name
  FROM customer
)"""


def km_sql(a: str, b: str) -> str:
    return (
        f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) "
        f"+ cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score: row_index, y, p, source, lang."""
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    d = doc.select("doc_id", "source", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))
    return lab.select("doc_id", F.col("quality").alias("y")).join(d, "doc_id").withColumnRenamed("doc_id", "row_index")


JUDGED = """
jd AS (
  SELECT l.doc_id AS row_index, quality AS y, source, lang, least(1.0, n_chars / 4000.0::DOUBLE) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""

METRICS = ("roc_auc", "average_precision", "balanced_accuracy", "precision", "recall", "f1")


def metrics_sql(src: str, by: str, out: str = "mx") -> str:
    """CTEs that end in ``out``: metrics of src(y, p) by the columns."""
    return f"""
{out}_r AS (
  SELECT {by}, y, p, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS rk FROM {src}
), {out}_t AS (
  SELECT {by}, p, sum(y) AS hits, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS n_top
  FROM {src} GROUP BY {by}, p WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
), {out}_a AS (
  SELECT {by}, sum(hits * tp / n_top) AS ap FROM {out}_t GROUP BY {by}
), {out}_c AS (
  SELECT {by}, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, sum(CASE WHEN y = 1 THEN rk END) AS rs,
         count(*) FILTER (y = 1 AND p >= 0.5)::BIGINT AS tp, count(*) FILTER (y = 0 AND p >= 0.5)::BIGINT AS fp,
         count(*) FILTER (y = 1 AND p < 0.5)::BIGINT AS fn, count(*) FILTER (y = 0 AND p < 0.5)::BIGINT AS tn
  FROM {out}_r GROUP BY {by}
), {out} AS (
  SELECT {by}, n_pos, n_neg,
         CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS roc_auc,
         CASE WHEN n_pos > 0 AND n_neg > 0 THEN ap / n_pos END AS average_precision,
         CASE WHEN n_pos > 0 AND n_neg > 0 THEN (tp / n_pos + tn / n_neg) / 2 END AS balanced_accuracy,
         coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(n_pos, 0), 0.0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, tn, fp, fn, tp
  FROM {out}_c JOIN {out}_a USING ({by})
)"""


METRIC_COLUMNS = "n_pos, n_neg, " + ", ".join(r(m, m) for m in METRICS) + ", tn, fp, fn, tp"

FOLDS = """
gs AS (SELECT source AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source DESC) AS k FROM jd GROUP BY source),
lpt(k, g, fold, load) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::INT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT gs.k, gs.g, (list_position(load, list_min(load)) - 1)::INT,
         list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + gs.n ELSE x END)
  FROM lpt JOIN gs ON gs.k = lpt.k + 1
)"""


@query(
    f"""WITH RECURSIVE {JUDGED}, {FOLDS},
fd AS (SELECT jd.*, fold FROM jd JOIN lpt ON source = g), {metrics_sql('fd', 'fold')},
rk AS (
  SELECT fold, y, row_number() OVER (PARTITION BY fold ORDER BY p DESC, row_index) AS rn, count(*) OVER (PARTITION BY fold) AS n,
         sum(y) OVER (PARTITION BY fold) AS np FROM fd
), tk AS (
  SELECT fold, f, greatest(1, ceil(n * f)) AS k, n, np, sum(y) AS hits, sum(y / log2(rn + 1)) AS dcg,
         sum(CASE WHEN rn <= np THEN 1 / log2(rn + 1) ELSE 0 END) AS ideal
  FROM rk, (SELECT unnest([0.05::DOUBLE, 0.10::DOUBLE]) AS f) WHERE rn <= greatest(1, ceil(n * f)) GROUP BY fold, f, n, np
), tw AS (
  SELECT fold, {', '.join(f"max(CASE WHEN f = {f}::DOUBLE THEN {e} END) AS top{t}_{m}" for f, t in ((0.05, '05'), (0.1, '10')) for m, e in (('precision', 'hits / k'), ('recall', 'hits / greatest(np, 1)'), ('f1', 'CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / k) * (hits / np) / (hits / k + hits / np) END'), ('lift', '(hits / k) / nullif(np / n, 0)'), ('ndcg', 'dcg / nullif(ideal, 0)')))}
  FROM tk GROUP BY fold
)
SELECT fold, {METRIC_COLUMNS}, {', '.join(r(f'top{t}_{m}', f'top{t}_{m}') for t in ('05', '10') for m in evaluate.TOP_METRICS)}
FROM mx JOIN tw USING (fold)"""
)
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped folds, then classification and top-fraction metrics of each."""
    folds = splits.group_kfold(judged(spark, sf_dir), "source", 5)
    top = evaluate.top_wide(evaluate.top_metrics(folds, ["fold"], fractions=(0.05, 0.10)), ["fold"], (0.05, 0.10))
    return rounded(evaluate.classification_metrics(folds, ["fold"]).join(top, "fold"))


@query(f"WITH RECURSIVE {JUDGED}, {FOLDS} SELECT row_index, source, fold FROM jd JOIN lpt ON source = g")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_kfold(judged(spark, sf_dir), "source", 5).select("row_index", "source", "fold")


@query(
    f"""WITH {JUDGED}, {metrics_sql('jd', 'lang')} SELECT lang, {METRIC_COLUMNS} FROM mx"""
)
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.classification_metrics(judged(spark, sf_dir), ["lang"]))


@query(
    f"""WITH {JUDGED}, {metrics_sql('jd', 'lang')}, al AS (SELECT *, 'all' AS g FROM jd), {metrics_sql('al', 'g', 'px')}
SELECT 'mean_of_groups' AS estimand, {r('avg(roc_auc)', 'roc_auc')}, {r('avg(average_precision)', 'average_precision')}, {r('avg(f1)', 'f1')} FROM mx
UNION ALL SELECT 'pooled', {r('roc_auc', 'roc_auc')}, {r('average_precision', 'average_precision')}, {r('f1', 'f1')} FROM px"""
)
def pooled_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimands that must not be mixed: mean over groups, and pooled."""
    d, cols = judged(spark, sf_dir), ["roc_auc", "average_precision", "f1"]
    mean = evaluate.classification_metrics(d, ["lang"]).agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit("mean_of_groups").alias("estimand"), *cols)
    pooled = evaluate.classification_metrics(d.withColumn("g", F.lit("all")), ["g"]).select(F.lit("pooled").alias("estimand"), *cols)
    return rounded(mean.unionByName(pooled))


@query(
    f"""WITH {JUDGED}, rk AS (
  SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY p DESC, row_index) AS rn, count(*) OVER (PARTITION BY lang) AS n, sum(y) OVER (PARTITION BY lang) AS np FROM jd
), tk AS (
  SELECT lang, f AS fraction, greatest(1, ceil(n * f))::BIGINT AS k, n, np, sum(y)::BIGINT AS hits, sum(y / log2(rn + 1)) AS dcg, sum(CASE WHEN rn <= np THEN 1 / log2(rn + 1) ELSE 0 END) AS ideal
  FROM rk, (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE, 0.20::DOUBLE]) AS f) WHERE rn <= greatest(1, ceil(n * f)) GROUP BY lang, f, n, np
)
SELECT lang, fraction, k, hits, {r('hits / k', 'precision')}, {r('hits / greatest(np, 1)', 'recall')},
       {r('CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / k) * (hits / np) / (hits / k + hits / np) END', 'f1')}, {r('(hits / k) / nullif(np / n, 0)', 'lift')}, {r('dcg / nullif(ideal, 0)', 'ndcg')} FROM tk"""
)
def top_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.top_metrics(judged(spark, sf_dir), ["lang"]))


TWO_SCORES = """
ts AS (
  SELECT env AS fold, 'base' AS model, y, qty / 50.0::DOUBLE AS p FROM it UNION ALL SELECT env, 'candidate', y, coalesce(disc, 0.05::DOUBLE) * 10 FROM it
)"""


def two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    base = it.select(F.col("env").alias("fold"), F.lit("base").alias("model"), "y", (F.col("qty") / 50.0).alias("p"))
    return base.unionByName(it.select(F.col("env").alias("fold"), F.lit("candidate").alias("model"), "y", (F.coalesce("disc", F.lit(0.05)) * 10).alias("p")))


@query(
    f"""WITH {ITEMS}, {TWO_SCORES}, {metrics_sql('ts', 'fold, model')}, wd AS (
  SELECT fold, {', '.join(f"max(CASE WHEN model = 'candidate' THEN {m} END) - max(CASE WHEN model = 'base' THEN {m} END) AS {m}" for m in ('roc_auc', 'average_precision', 'f1'))} FROM mx GROUP BY fold
), lg AS (UNPIVOT wd ON roc_auc, average_precision, f1 INTO NAME metric VALUE delta)
SELECT metric, count(delta) AS n_folds, {r('avg(delta)', 'mean_delta')}, count(*) FILTER (delta > 1e-12) AS better, count(*) FILTER (abs(delta) <= 1e-12) AS equal, count(*) FILTER (delta < -1e-12) AS worse FROM lg GROUP BY metric"""
)
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.classification_metrics(two_scores(spark, sf_dir), ["fold", "model"])
    return rounded(evaluate.paired_contrast(m, ["fold"], "model", "base", "candidate", ["roc_auc", "average_precision", "f1"]))


@query(
    f"""WITH {ITEMS}, {TWO_SCORES}, {metrics_sql('ts', 'fold, model')}
SELECT model, {', '.join(f"{r(f'avg({m})', f'{m}_mean')}, {r(f'stddev_samp({m})', f'{m}_std')}, count({m}) AS {m}_count" for m in ('roc_auc', 'f1'))} FROM mx GROUP BY model"""
)
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.classification_metrics(two_scores(spark, sf_dir), ["fold", "model"])
    return rounded(evaluate.summarize(m, ["model"], ["roc_auc", "f1"]))


REGION_DRAWS = "dr AS (SELECT i AS iteration, ((i * i + 3) * k * k + (2 * i + 1) * k + i * 3) % 11 % 5 AS env, count(*) AS times FROM range(20) a(i), range(5) b(k) GROUP BY ALL)"


@query(
    f"""WITH {ITEMS}, {REGION_DRAWS}, sc AS (
  SELECT iteration, model, y, p, times FROM dr JOIN (SELECT env, 'base' AS model, y, qty / 50.0::DOUBLE AS p FROM it UNION ALL SELECT env, 'candidate', y, coalesce(disc, 0.05::DOUBLE) * 10 FROM it) s USING (env)
), rp AS (SELECT iteration, model, y, p FROM sc, range(times)), {metrics_sql('rp', 'iteration, model')}, df AS (
  SELECT iteration, max(CASE WHEN model = 'candidate' THEN roc_auc END) - max(CASE WHEN model = 'base' THEN roc_auc END) AS d FROM mx GROUP BY iteration
)
SELECT 'roc_auc' AS metric, {r('avg(d)', 'mean_delta')}, {r('quantile_cont(d, 0.025)', 'low')}, {r('quantile_cont(d, 0.975)', 'high')}, {r('avg((d > 0)::INT)', 'share_above_0')}, count(d) AS iterations FROM df"""
)
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences over resamples of all regions, with a table of draws."""
    it = items(spark, sf_dir)
    scores = it.select("env", "y", F.inline(F.array(F.struct(F.lit("base").alias("model"), (F.col("qty") / 50.0).alias("p")), F.struct(F.lit("candidate").alias("model"), (F.coalesce("disc", F.lit(0.05)) * 10).alias("p")))))
    i, k = F.col("iteration"), F.col("k")
    grid = spark.range(20).select(F.col("id").alias("iteration"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    times = grid.groupBy("iteration", (((i * i + 3) * k * k + (2 * i + 1) * k + i * 3) % 11 % 5).cast(dict(it.dtypes)["env"]).alias("env")).agg(F.count("*").alias("times"))
    m = evaluate.cluster_bootstrap(scores, times, "env", ["base", "candidate"])
    return rounded(evaluate.bootstrap_interval(m, "base", "candidate", "roc_auc"))


ALL_DRAWS = "dr AS (SELECT i AS iteration, ((i * i + 3 * i + 7) * k * k * k + (5 * i + 1) * k * k + 11 * k + i) % 101 * 7 % 25 AS state, count(*) AS times FROM range(20) a(i), range(25) b(k) GROUP BY ALL)"


def state_draws(spark: SparkSession) -> DataFrame:
    """25 draws with repeats from the 25 states in each of 20 iterations."""
    i, k = F.col("iteration"), F.col("k")
    grid = spark.range(20).select(F.col("id").alias("iteration"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    state = ((i * i + 3 * i + 7) * k * k * k + (5 * i + 1) * k * k + 11 * k + i) % 101 * 7 % 25
    return grid.groupBy("iteration", state.cast("int").alias("state")).agg(F.count("*").alias("times"))


@query(
    f"""WITH {ITEMS}, {ALL_DRAWS}, sc AS (
  SELECT iteration, model, y, p, times FROM dr JOIN (SELECT state, 'base' AS model, y, qty / 50.0::DOUBLE AS p FROM it UNION ALL SELECT state, 'candidate', y, coalesce(disc, 0.05::DOUBLE) * 10 FROM it) s ON s.state = dr.state
), rp AS (SELECT iteration, model, y, p FROM sc, range(times)), {metrics_sql('rp', 'iteration, model')}, df AS (
  SELECT iteration, max(CASE WHEN model = 'candidate' THEN roc_auc END) - max(CASE WHEN model = 'base' THEN roc_auc END) AS d FROM mx GROUP BY iteration
)
SELECT 'roc_auc' AS metric, {r('avg(d)', 'mean_delta')}, {r('quantile_cont(d, 0.025)', 'low')}, {r('quantile_cont(d, 0.975)', 'high')}, {r('avg((d > 0)::INT)', 'share_above_0')}, count(d) AS iterations FROM df"""
)
def cluster_bootstrap_all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences over resamples of all states."""
    it = items(spark, sf_dir)
    scores = it.select("state", "y", F.inline(F.array(F.struct(F.lit("base").alias("model"), (F.col("qty") / 50.0).alias("p")), F.struct(F.lit("candidate").alias("model"), (F.coalesce("disc", F.lit(0.05)) * 10).alias("p")))))
    m = evaluate.cluster_bootstrap(scores, state_draws(spark), "state", ["base", "candidate"])
    return rounded(evaluate.bootstrap_interval(m, "base", "candidate", "roc_auc"))


def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores of every item, with its state."""
    two = F.array(F.struct(F.lit("base").alias("model"), (F.col("qty") / 50.0).alias("p")), F.struct(F.lit("candidate").alias("model"), (F.coalesce("disc", F.lit(0.05)) * 10).alias("p")))
    return items(spark, sf_dir).select("row_index", "state", "y", F.inline(two))


def intervals(drawn: DataFrame, names) -> DataFrame:
    held = settled(drawn)
    return rounded(guards.union_all([evaluate.bootstrap_interval(held, "base", "candidate", m) for m in names]))


MANY = 2000
RANKED = ("roc_auc", "average_precision", "f1")


@query(
    f"""WITH {ITEMS}, {ALL_DRAWS.replace('range(20)', f'range({MANY})')}, ce AS (
  SELECT state, model, p, sum(y) AS a, sum(1 - y) AS b FROM (SELECT state, y, 'base' AS model, qty / 50.0::DOUBLE AS p FROM it UNION ALL SELECT state, y, 'candidate', coalesce(disc, 0.05::DOUBLE) * 10 FROM it) GROUP BY ALL
), wc AS (SELECT iteration, model, p, sum(a * times) AS a, sum(b * times) AS b FROM ce JOIN dr USING (state) GROUP BY ALL
), cu AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp FROM wc WINDOW w AS (PARTITION BY iteration, model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
), ms AS (SELECT iteration, model, sum(b * (tp - a / 2)) / (sum(a) * sum(b)) AS roc_auc, sum(CASE WHEN a > 0 THEN a * tp / (tp + fp) ELSE 0 END) / sum(a) AS average_precision,
    2 * sum(CASE WHEN p >= 0.5 THEN a ELSE 0 END) / (sum(CASE WHEN p >= 0.5 THEN a + b ELSE 0 END) + sum(a)) AS f1 FROM cu GROUP BY iteration, model
), df AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, iteration, max(CASE WHEN model = 'candidate' THEN {m} END) - max(CASE WHEN model = 'base' THEN {m} END) AS d FROM ms GROUP BY iteration" for m in RANKED)})
SELECT metric, {r('avg(d)', 'mean_delta')}, {r('quantile_cont(d, 0.025)', 'low')}, {r('quantile_cont(d, 0.975)', 'high')}, {r('avg((d > 0)::INT)', 'share_above_0')}, count(d) AS iterations FROM df GROUP BY metric"""
)
def cluster_bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences over 2,000 resamples of all states, by a table of
    draws that SQL can make too."""
    i, k = np.arange(MANY)[:, None], np.arange(25)[None]
    drawn = ((i * i + 3 * i + 7) * k * k * k + (5 * i + 1) * k * k + 11 * k + i) % 101 * 7 % 25
    times = np.stack([np.bincount(d, minlength=25) for d in drawn])
    return intervals(evaluate.bootstrap_draws(state_scores(spark, sf_dir), "state", times, range(25), names=RANKED), RANKED)


@query()
def cluster_bootstrap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven metrics in 2,000 seeded resamples of all states. Seeded draws
    and top shares of repeated rows are beyond SQL; tests hold both."""
    scores = state_scores(spark, sf_dir)
    states = sorted(r["state"] for r in items(spark, sf_dir).select("state").distinct().collect())  # nations
    return intervals(evaluate.bootstrap_draws(scores, "state", splits.drawn_times(len(states), MANY, 20260622), states), evaluate.DRAW_METRICS)


@query(
    f"""WITH {ITEMS}, cc AS (SELECT row_index % 97 AS repeat, avg(qty) AS v FROM it GROUP BY 1), ob AS (SELECT avg(qty) + 0.05 AS o FROM it)
SELECT {r('max(o)', 'observed')}, count(*) AS repeats, {r('avg(v)', 'control_mean')}, {r('quantile_cont(v, 0.95)', 'control_p95')}, {r('(1.0 + count(*) FILTER (v >= o)) / (1.0 + count(*))', 'empirical_p')}, {r('avg((v < o)::INT)', 'percentile')} FROM cc, ob"""
)
def random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    control = it.groupBy((F.col("row_index") % 97).alias("repeat")).agg(F.avg("qty").alias("v"))
    return rounded(evaluate.random_control(control, it.agg((F.avg("qty") + 0.05).alias("v")), "v"))


@query(
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{role}' AS role, '{t}' AS dtype, avg(({c} IS NULL)::INT)::DOUBLE AS missing_rate, count(DISTINCT {c}) AS n_unique, {num} AS is_numeric, {num and role != 'target'} AS used_in_m1_full_climate, {num and role not in ('target', 'climate')} AS used_in_m2_no_climate, {num and role in ('geochemistry', 'geo_structure', 'other_numeric')} AS used_in_m3_climate_normalized, false AS used_as_climate_adjuster FROM lineitem"
        for i, (c, role, t, num) in enumerate((
            ("l_orderkey", "other_numeric", "bigint", True), ("l_partkey", "other_numeric", "bigint", True), ("l_suppkey", "other_numeric", "bigint", True), ("l_linenumber", "other_numeric", "int", True),
            ("l_quantity", "geochemistry", "double", True), ("l_extendedprice", "geochemistry", "double", True), ("l_discount", "climate", "double", True), ("l_tax", "climate", "double", True),
            ("l_returnflag", "target", "string", False), ("l_linestatus", "other_non_numeric", "string", False), ("l_shipdate", "other_non_numeric", "timestamp", False),
        ))
    ) + ") SELECT * FROM c"
)
def role_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    R = catalog.RoleRule
    rules = (R("exact", "l_returnflag", "target"), R("contains", "price", "geochemistry"), R("prefix", "l_quant", "geochemistry"), R("exact", "l_discount", "climate"), R("exact", "l_tax", "climate"))
    li = table(spark, sf_dir, "lineitem")
    if dict(li.dtypes)["l_shipdate"] == "timestamp_ntz":
        li = li.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    return catalog.role_catalog(li, rules)


RULES = (("exact", "STANDARD BRUSHED TIN", "brushed", "signal"), ("prefix", "STANDARD", "standard", "context"), ("contains", "TIN", "tin", "signal"), ("prefix", "ECONOMY", "economy", "context"))


@query(
    f"""WITH rl AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{p}', '{c}', '{o}')" for i, (k, p, c, o) in enumerate(RULES))}) v(rule_no, match_type, pattern, concept, role)), ft AS (SELECT DISTINCT p_type AS feature_name FROM part), hit AS (
  SELECT feature_name, rl.*, row_number() OVER (PARTITION BY feature_name ORDER BY rule_no) AS nth FROM ft JOIN rl
  ON (match_type = 'exact' AND feature_name = pattern) OR (match_type = 'prefix' AND starts_with(feature_name, pattern)) OR (match_type = 'contains' AND contains(feature_name, pattern)))
SELECT ft.feature_name, rule_no, match_type, pattern, concept, role, rule_no IS NOT NULL AS mapped FROM ft LEFT JOIN hit ON ft.feature_name = hit.feature_name AND nth = 1"""
)
def first_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = catalog.rules_frame(spark, RULES, "match_type string, pattern string, concept string, role string")
    return catalog.resolve_first_match(table(spark, sf_dir, "part").select(F.col("p_type").alias("feature_name")).distinct(), rules)


def z_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN greatest(-8.0, least(8.0, CASE WHEN {c}_q3 - {c}_q1 >= 1e-12 THEN ({c} - {c}_q2) / ({c}_q3 - {c}_q1) "
        f"WHEN coalesce({c}_sd, 0) > 1e-12 THEN ({c} - {c}_m) / {c}_sd ELSE 0.0 END)) END"
    )


Z_COLUMNS = ("qty", "price", "disc", "tax")
Z_SQL = f"""{ITEMS}, qs AS (
  SELECT {', '.join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3, stddev_samp({c}) AS {c}_sd, avg({c}) AS {c}_m" for c in Z_COLUMNS)} FROM it
), zs AS (SELECT it.*, {', '.join(f"{z_sql(c)} AS {c}_z" for c in Z_COLUMNS)} FROM it, qs)"""


@query(f"WITH {Z_SQL} SELECT row_index, {', '.join(r(f'{c}_z', f'{c}_z') for c in Z_COLUMNS)} FROM zs")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.with_robust_z(items(spark, sf_dir), Z_COLUMNS).select("row_index", *[f"{c}_z" for c in Z_COLUMNS]))


@query(
    f"""WITH {Z_SQL} SELECT row_index, {r('greatest(qty_z, price_z)', 'concept_signal')}, {r('list_median(list_filter([-disc_z, tax_z, price_z], lambda x: x IS NOT NULL))', 'concept_context')}, greatest(y, (state % 2)::INT)::INT AS concept_flag FROM zs"""
)
def concept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = stats.with_robust_z(items(spark, sf_dir), Z_COLUMNS)
    concepts = (
        {"concept": "concept_signal", "features": ["qty", "price"], "role": "pathfinder_signal"},
        {"concept": "concept_context", "features": ["disc", "tax", "price"], "role": "context", "reverse": ["disc"]},
        {"concept": "concept_flag", "features": ["y", "odd"], "role": "context", "binary": True},
    )
    cols = catalog.concept_columns(concepts, {c: F.col(f"{c}_z") for c in Z_COLUMNS}, {"y": F.col("y"), "odd": (F.col("state") % 2).cast("int")})
    return rounded(z.select("row_index", *[c.alias(k) for k, c in cols.items()]))


EFFECTS_SQL = f"""{ITEMS}, lg AS (
  {' UNION ALL '.join(f"SELECT env, y, '{c}' AS concept, {c}::DOUBLE AS v FROM it" for c in Z_COLUMNS)}
), rk AS (
  SELECT env, concept, y, rank() OVER (PARTITION BY env, concept ORDER BY v) + (count(*) OVER (PARTITION BY env, concept, v) - 1) / 2.0 AS rk FROM lg WHERE v IS NOT NULL
), au AS (
  SELECT env, concept, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM rk GROUP BY env, concept
), sm AS (
  SELECT env, concept, count(v) FILTER (y = 1) AS n1, count(v) FILTER (y = 0) AS n0, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0, var_samp(v) FILTER (y = 1) AS v1, var_samp(v) FILTER (y = 0) AS v0,
         median(v) FILTER (y = 1) AS d1, median(v) FILTER (y = 0) AS d0, avg((v IS NULL)::INT) AS missing_rate FROM lg GROUP BY env, concept
), ef AS (
  SELECT env, concept, n1 AS n_positive, n0 AS n_negative, m1 - m0 AS mean_difference, d1 - d0 AS median_difference, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS cohen_d,
         auc, 2 * abs(auc - 0.5) AS auc_strength, CASE WHEN m1 - m0 > 0 THEN 'positive_higher' ELSE 'negative_higher' END AS direction, missing_rate FROM sm JOIN au USING (env, concept)
)"""


@query(
    f"WITH {EFFECTS_SQL} SELECT env, concept, n_positive, n_negative, {', '.join(r(c, c) for c in ('mean_difference', 'median_difference', 'cohen_d', 'auc', 'auc_strength'))}, direction, {r('missing_rate', 'missing_rate')} FROM ef"
)
def environment_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.feature_effects(items(spark, sf_dir), "env", "y", Z_COLUMNS))


@query(
    f"""WITH {EFFECTS_SQL}, vt AS (SELECT *, auc_strength >= 0.01 OR coalesce(rank() OVER (PARTITION BY env ORDER BY round(abs(cohen_d), 9) DESC NULLS LAST) <= 1, false) AS sel FROM ef),
g AS (SELECT concept, count(*) FILTER (sel) AS n_selected, coalesce(array_to_string(list_sort(list_distinct(list(env::VARCHAR) FILTER (sel))), ';'), '') AS environments, avg(auc) AS mean_auc, count(DISTINCT CASE WHEN sel THEN direction END) AS dirs FROM vt GROUP BY concept)
SELECT concept, n_selected, environments, {r('mean_auc', 'mean_auc')}, {r('n_selected / 5', 'stable_score')}, dirs = 1 AS direction_consistent,
       CASE WHEN n_selected >= 5 AND dirs = 1 THEN 'cross_environment_stable_signal' WHEN n_selected / 5 >= 2 / 3 AND dirs = 1 THEN 'mostly_stable_signal' WHEN n_selected > 0 AND dirs <> 1 THEN 'environment_sensitive_or_direction_conflict' WHEN n_selected > 0 THEN 'environment_specific_signal' ELSE 'not_selected_in_main_environments' END AS signal_class,
       n_selected >= 2 AS is_candidate FROM g"""
)
def signal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stats.feature_effects(items(spark, sf_dir), "env", "y", Z_COLUMNS).withColumn("size", F.round(F.abs("cohen_d"), 9))
    return rounded(graph.vote_signals(e, 5, auc_threshold=0.01, top_rank=1, importance="size"))


SPEARMAN_SQL = f"""{ITEMS}, pr AS (
  {' UNION ALL '.join(f"SELECT '{t}' AS target, '{c}' AS covariate, {t}::DOUBLE AS a, {c}::DOUBLE AS b FROM it WHERE {t} IS NOT NULL AND {c} IS NOT NULL" for t in ('price', 'qty') for c in ('disc', 'tax'))}
), rk AS (
  SELECT target, covariate, rank() OVER (PARTITION BY target, covariate ORDER BY a) + (count(*) OVER (PARTITION BY target, covariate, a) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY target, covariate ORDER BY b) + (count(*) OVER (PARTITION BY target, covariate, b) - 1) / 2.0 AS rb FROM pr
), sp AS (SELECT target, covariate, count(*) AS n_pairs, corr(ra, rb) AS spearman FROM rk GROUP BY target, covariate)"""


@query(f"WITH {SPEARMAN_SQL} SELECT target, covariate, n_pairs, {r('spearman', 'spearman')} FROM sp")
def spearman_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"]))


@query(
    f"""WITH {SPEARMAN_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(spearman) DESC, covariate) AS nth FROM sp)
SELECT target AS target_column, covariate AS best_climate_column, {r('spearman', 'spearman')}, {r('abs(spearman)', 'spearman_abs_max')}, n_pairs AS n_pair_at_best, abs(spearman) >= 0.005 AS is_spearman_sensitive FROM b WHERE nth = 1"""
)
def spearman_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman_screen(stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"]), 0.005))


@query(
    f"""WITH {ITEMS}, md AS (SELECT median(price) AS p, median(disc) AS d FROM it), fl AS (SELECT row_index, coalesce(price, p) AS a, coalesce(disc, d) AS x, tax AS t FROM it, md),
st AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(t) AS mt, stddev_pop(t) AS st, avg(a) AS ma, count(*) AS n FROM fl), z AS (SELECT row_index, a, (x - mx) / sx AS u, (t - mt) / st AS v, ma FROM fl, st),
g AS (SELECT sum(u * u) + 10 AS uu, sum(v * v) + 10 AS vv, sum(u * v) AS uv, sum(u * (a - ma)) AS ua, sum(v * (a - ma)) AS va FROM z), w AS (SELECT (ua * vv - va * uv) / (uu * vv - uv * uv) AS wu, (va * uu - ua * uv) / (uu * vv - uv * uv) AS wv FROM g)
SELECT row_index, round(a - ma - u * wu - v * wv, 4) + 0.0 AS price_climate_resid FROM z, w"""
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge residuals of price on discount and tax."""
    it = items(spark, sf_dir)
    fitted = stats.Residualizer(["price"], ["disc", "tax"]).fit(it)
    return rounded(fitted.transform(it).select("row_index", "price_climate_resid"), 4)


@query(
    f"""WITH {ITEMS}, md AS (SELECT median(price) AS p, median(disc) AS d FROM it), f AS (SELECT qty AS a, coalesce(price, p) AS b, coalesce(disc, d) AS x FROM it, md),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(x) AS mx, count(*) AS n FROM f), c AS (SELECT a - ma AS a, b - mb AS b, x - mx AS x FROM f, m),
s AS (SELECT sum(a * x) / (sum(x * x) + 1) AS wa, sum(b * x) / (sum(x * x) + 1) AS wb FROM c)
SELECT 'qty' AS a, 'price' AS b, {r('corr(a - wa * x, b - wb * x)', 'partial_corr')}, count(*) AS n FROM c, s"""
)
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    fill = stats.medians(it, ["qty", "price", "disc"])
    g = stats.gram(it, [F.coalesce(F.col(c), F.lit(fill[c])) for c in fill], list(fill))
    value, _ = stats.ridge_partial_corr(g, "qty", "price")
    return rounded(spark.createDataFrame([("qty", "price", value, int(g.n))], "a string, b string, partial_corr double, n long"))


@query(
    f"WITH {ITEMS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM it" for a in ("price", "qty") for b in ("disc", "tax")) + ")"
)
def pairwise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pairwise_counts(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"])


@query(f"WITH {POINTS} SELECT id, y, ((row_number() OVER (PARTITION BY y ORDER BY id * 7919 % 10007, id) - 1) % 5)::INT AS fold FROM pt")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_kfold(points(spark, sf_dir), "y", [F.col("id") * 7919 % 10007, "id"]).select("id", "y", "fold")


@query(f"WITH {POINTS} SELECT id, state, (dense_rank() OVER (ORDER BY state) - 1)::INT AS fold FROM pt")
def one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_group_out(points(spark, sf_dir), "state").select("id", "state", "fold")


@query(
    f"""WITH {POINTS}, h AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY id * 31 % 1009, id) AS rn, count(*) OVER (PARTITION BY state) AS n FROM pt WHERE y = 0 AND segment <> 'BUILDING'),
b AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY id * 31 % 1009, id) AS rn, count(*) OVER (PARTITION BY state) AS n FROM pt WHERE y = 0 AND segment = 'BUILDING'), p AS (SELECT id FROM pt WHERE y = 1)
SELECT 'hard_only' AS scheme, id FROM h UNION ALL SELECT 'hard_only', id FROM p UNION ALL SELECT 'background_only', id FROM b UNION ALL SELECT 'background_only', id FROM p
UNION ALL SELECT 'mixed', id FROM h WHERE rn <= n // 2 UNION ALL SELECT 'mixed', id FROM b WHERE rn <= n // 2 UNION ALL SELECT 'mixed', id FROM p"""
)
def negative_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = points(spark, sf_dir)
    hard, back = pt.where("y = 0 and segment <> 'BUILDING'"), pt.where("y = 0 and segment = 'BUILDING'")
    return splits.negative_schemes(pt.where("y = 1"), hard, back, ["state"], [F.col("id") * 31 % 1009, "id"]).select("scheme", "id")


@query(f"WITH {POINTS} SELECT id, '2deg_' || floor((lon + 180) / 2)::BIGINT || '_' || floor((lat + 90) / 2)::BIGINT AS block FROM pt")
def grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", spatial.block_id(F.col("lon"), F.col("lat"), 2).alias("block"))


@query(
    f"""WITH {POINTS}, d AS (SELECT a.id, b.state AS r_state, b.id AS r_id, {km_sql('a', 'b')} AS km FROM pt a JOIN pt b ON a.state <> b.state)
SELECT id, r_state, min_by(r_id, (round(km, 9), r_id)) AS r_id, round(min(km), 4) + 0.0 AS km_apart FROM d GROUP BY id, r_state HAVING min(km) <= 150"""
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest customer of every other state within 150 km of each."""
    pt = points(spark, sf_dir)
    return rounded(spatial.nearest(pt, pt, "id", "id", fold="state", each_fold=True, within_km=150.0).select("id", "r_state", "r_id", "km_apart"), 4)


@query(
    f"""WITH {POINTS}, f AS (SELECT DISTINCT state FROM pt WHERE state IS NOT NULL), n AS (SELECT count(*) AS n FROM pt),
c AS (SELECT f.state, count(*) AS n FROM pt a JOIN f ON a.state <> f.state WHERE EXISTS (SELECT 1 FROM pt b WHERE b.state = f.state AND abs(a.lat - b.lat) < 0.2 AND {km_sql('a', 'b')} <= 20) GROUP BY f.state)
SELECT f.state, count(*) AS own, any_value(n.n) - count(*) - coalesce(any_value(c.n), 0) AS n_train FROM pt JOIN f USING (state) LEFT JOIN c USING (state), n GROUP BY f.state"""
)
def buffer_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each state as the test fold, its rows and the training rows that a
    buffer of 20 km around them leaves."""
    pt = points(spark, sf_dir)
    left = spatial.remove_buffers(pt, "state", "id", 20.0).groupBy("state").agg(F.count("*").alias("_left"))
    own = pt.where("state is not null").groupBy("state").agg(F.count("*").alias("own"))
    # a state whose buffer takes every other row stays, with none left
    return own.join(left, "state", "left").select("state", "own", F.coalesce("_left", F.lit(0)).alias("n_train"))


def folded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their fold; those without a state are a fold of their own."""
    return points(spark, sf_dir).select(F.coalesce(F.col("state") % 5, F.lit(5)).cast("int").alias("fold"), "id", "lat", "lon")


FOLDED = f"{POINTS}, pf AS (SELECT coalesce(state % 5, 5)::INT AS fold, id, lat, lon FROM pt)"


@query(
    f"""WITH {FOLDED}, d AS (SELECT a.fold, a.id, b.id AS r_id, {km_sql('a', 'b')} AS km FROM pf a JOIN pf b ON a.fold <> b.fold)
SELECT fold, id, min_by(r_id, (round(km, 9), r_id)) AS r_id, round(min(km), 4) + 0.0 AS km_apart FROM d GROUP BY fold, id"""
)
def nearest_neighbours_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest customer of another fold for every customer."""
    pt = folded_points(spark, sf_dir)
    return rounded(spatial.nearest(pt, pt, "id", "id", fold="fold"), 4)


@query(
    f"""WITH {FOLDED}, f AS (SELECT DISTINCT fold FROM pf)
SELECT f.fold, a.id FROM pf a JOIN f ON a.fold <> f.fold WHERE NOT EXISTS (SELECT 1 FROM pf b WHERE b.fold = f.fold AND abs(a.lat - b.lat) < 0.2 AND {km_sql('a', 'b')} <= 20)"""
)
def buffer_removal_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training customers left by a buffer of 20 km around each test fold."""
    return spatial.remove_buffers(folded_points(spark, sf_dir), "fold", "id", 20.0)


@query(
    f"""WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS a, b.id AS b FROM pt a, pt b WHERE a.id <> b.id AND abs(a.lat - b.lat) < 0.3 AND {km_sql('a', 'b')} <= 25),
rc(id, c) AS (SELECT id, id FROM pt UNION SELECT e.b, rc.c FROM rc JOIN e ON rc.id = e.a WHERE rc.c < e.b)
SELECT id, min(c) AS cluster FROM rc GROUP BY id"""
)
def distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.eps_components(points(spark, sf_dir), "id", 25.0)


LINKS = (10, 15, 20, 25)


@query(
    f"""WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS a, b.id AS b, {km_sql('a', 'b')} AS km FROM pt a, pt b WHERE a.id <> b.id AND abs(a.lat - b.lat) < 0.3 AND abs(a.lon - b.lon) < 0.5), r AS (SELECT unnest([{', '.join(map(str, LINKS))}]) AS eps),
rc(eps, id, c) AS (SELECT eps, id, id FROM pt, r UNION SELECT rc.eps, e.b, rc.c FROM rc JOIN e ON rc.id = e.a AND e.km <= rc.eps WHERE rc.c < e.b), m AS (SELECT eps, id, min(c) AS cluster FROM rc GROUP BY eps, id)
SELECT id, {', '.join(f"max(cluster) FILTER (eps = {x}) AS cluster_{x}" for x in LINKS)} FROM m GROUP BY id"""
)
def linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of customers at four distances from one spanning forest."""
    return spatial.linkage(points(spark, sf_dir), "id", LINKS)


@query(
    f"""WITH {ITEMS} SELECT env, y, i::INT AS iteration, count(*) AS drawn FROM it, range(100) a(i) GROUP BY env, y, i"""
)
def resample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn of each class of each region in 100 resamples: exactly as
    many as there are. Tests hold the draws themselves."""
    drawn = splits.resampled(items(spark, sf_dir), ["env", "y"], ["row_index"])
    sums = drawn.groupBy("env", "y").agg(*[F.sum(F.get("times", F.lit(i))).alias(f"t{i}") for i in range(100)])
    return sums.select("env", "y", F.posexplode(F.array(*[f"t{i}" for i in range(100)])).alias("iteration", "drawn"))


@query()
def resampled_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection rates over 100 resamples within class; the draws are random,
    so tests hold them, and ``selection_rates_of_100`` the rates."""
    drawn = splits.resampled(items(spark, sf_dir), ["env", "y"], ["row_index"])
    return rounded(stats.selection_rates(drawn, "env", "y", ["qty", "price", "disc", "tax"], lambda i: F.get("times", F.lit(i)), top_k=2))


@query(
    f"""WITH {POINTS}, cl AS (SELECT i * 100 + j AS cell, 31.25 + i * 0.5 AS lat, -124.75 + j * 0.5 AS lon FROM range(30) a(i), range(40) b(j)),
d AS (SELECT p.id, c.cell, abs(p.lat - c.lat) <= 0.250001 AND abs(p.lon - c.lon) <= 0.250001 AS inside, row_number() OVER (PARTITION BY p.id ORDER BY round(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2), 9), c.cell) AS nth
      FROM pt p, cl c WHERE abs(p.lat - c.lat) < 2.5 AND abs(p.lon - c.lon) < 2.5)
SELECT id, cell, inside AS in_cell FROM d WHERE nth = 1 AND inside"""
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points strictly nearest to a cell centre whose box holds them."""
    i, j = F.floor(F.col("id") / 40), F.col("id") % 40
    cells = spark.range(1200).select((i * 100 + j).alias("cell"), (31.25 + i * 0.5).cast("double").alias("lat"), (-124.75 + j * 0.5).cast("double").alias("lon"))
    return spatial.grid_cell(points(spark, sf_dir), cells, "id").where("in_cell")


@query(
    f"""WITH {POINTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY bal DESC, id) AS rn, count(*) OVER (PARTITION BY state) AS n FROM pt), t AS (SELECT *, rn <= greatest(1, ceil(n * 0.1::DOUBLE)) AS top, id % 50 AS cl FROM rk)
SELECT state, count(*) FILTER (top) AS candidate_rows, count(*) FILTER (top AND y = 1) AS positive_rows, count(DISTINCT cl) FILTER (top AND y = 1) AS clusters_hit, count(DISTINCT cl) FILTER (y = 1) AS clusters,
       count(*) FILTER (top AND y = 1) - count(DISTINCT cl) FILTER (top AND y = 1) AS duplicates, {r('count(DISTINCT cl) FILTER (top AND y = 1) / nullif(count(DISTINCT cl) FILTER (y = 1), 0)', 'cluster_recall')} FROM t GROUP BY state"""
)
def distinct_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = points(spark, sf_dir).withColumn("cl", F.col("id") % 50)
    return rounded(evaluate.distinct_top(pt, ["state"], "cl", 0.1, order="id", p="bal"))


@query(
    f"""WITH {POINTS}, k AS (SELECT y, state, 'coordinate' AS kind, round(lat, 1)::VARCHAR || ',' || round(lon, 1)::VARCHAR AS key FROM pt UNION ALL SELECT y, state, 'name', regexp_replace(lower(trim(name)), '[^a-z]+', '', 'g') FROM pt),
g AS (SELECT kind, key, count(*) AS n, min(y) AS l0, max(y) AS l1, min(state) AS r0, max(state) AS r1 FROM k GROUP BY kind, key HAVING count(*) > 1)
SELECT kind, count(*) AS n_groups, sum(n)::BIGINT AS n_rows, count(*) FILTER (l0 <> l1) AS n_label_conflicts, count(*) FILTER (r0 <> r1) AS n_cross_region FROM g GROUP BY kind"""
)
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    coordinate = F.concat_ws(",", F.round("lat", 1).cast("string"), F.round("lon", 1).cast("string"))
    letters = F.regexp_replace(S.normalised_name(F.col("name")), "[0-9]", "")
    return evaluate.duplicate_audit(points(spark, sf_dir), {"coordinate": coordinate, "name": letters}, "y", "state")


@query(
    f"""WITH {ITEMS}, s AS (SELECT 1 / (1 + exp(-(qty / 50 - tax * 10))) AS o, 1 / (1 + exp(-(qty * 1.1::DOUBLE / 50 - tax * 10))) AS p, 1 / (1 + exp(-(qty * 0.9::DOUBLE / 50 - tax * 10))) AS m FROM it), l AS (SELECT 'plus' AS scenario, p - o AS d FROM s UNION ALL SELECT 'minus', m - o FROM s)
SELECT scenario, {r('avg(d)', 'mean_delta')}, {r('avg(abs(d))', 'mean_abs_delta')}, {r('median(abs(d))', 'median_abs_delta')}, {r('quantile_cont(abs(d), 0.95)', 'p95_abs_delta')}, {r('max(abs(d))', 'max_abs_delta')}, {r('avg((abs(d) > 0.05)::INT)', 'share_over_005')} FROM l GROUP BY scenario"""
)
def perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    p = lambda qty: S.sigmoid(qty / 50 - F.col("tax") * 10)
    scored = it.select(p(F.col("qty")).alias("o"), *[p(evaluate.perturbed(["qty"], s, {})["qty"]).alias(s) for s in ("plus", "minus")])
    return rounded(evaluate.perturbation_effect(scored, "o", {"plus": "plus", "minus": "minus"}))


@query(
    f"""WITH {ITEMS}, s AS (SELECT 1 / (1 + exp(-(tax * 100 - qty / 10))) AS o, 1 / (1 + exp(-(tax * 100 + 1 - qty * 1.1::DOUBLE / 10))) AS p, 1 / (1 + exp(-(tax * 100 - 1 - qty * 0.9::DOUBLE / 10))) AS m FROM it), l AS (SELECT 'plus' AS scenario, p - o AS d FROM s UNION ALL SELECT 'minus', m - o FROM s)
SELECT scenario, {r('avg(d)', 'mean_delta')}, {r('avg(abs(d))', 'mean_abs_delta')}, {r('median(abs(d))', 'median_abs_delta')}, {r('quantile_cont(abs(d), 0.95)', 'p95_abs_delta')}, {r('max(abs(d))', 'max_abs_delta')}, {r('avg((abs(d) > 0.05)::INT)', 'share_over_005')} FROM l GROUP BY scenario"""
)
def perturbation_of_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column named as a temperature moves by a degree, another by a tenth."""
    it = items(spark, sf_dir).select((F.col("tax") * 100).alias("env_Temperature_annual_mean"), F.col("qty").alias("env_rain_annual_sum"))
    p = lambda of: S.sigmoid(of["env_Temperature_annual_mean"] - of["env_rain_annual_sum"] / 10)
    scored = it.select(*[p(evaluate.perturbed(it.columns, s, {})).alias(s) for s in evaluate.SHIFTS])
    return rounded(evaluate.perturbation_effect(scored, "original", {"plus": "plus", "minus": "minus"}))


@query()
def environment_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of all four kinds of evidence, each from the rows: AUC, selection
    rates over 100 exact resamples, the importances of a forest, and the sparse
    logistic models of all regions. Draws and learners are beyond SQL; tests
    hold each of them."""
    columns = ["qty", "price", "disc", "tax"]
    it = settled(items(spark, sf_dir))
    rates = stats.selection_rates(splits.resampled(it, ["env", "y"], ["row_index"]), "env", "y", columns, lambda i: F.get("times", F.lit(i)), top_k=2)
    sparse = spark.createDataFrame([(e, c, b) for e, _, c, b in logistic.coefficients(logistic.fit_all(it, columns, "y", by=["env"]))], f"env {dict(it.dtypes)['env']}, concept string, coefficient double")
    forests = forest_of_cells.importances(it, "env", columns, "y", forest_of_cells.Settings(trees=500))
    forest = spark.createDataFrame(forests, f"env {dict(it.dtypes)['env']}, concept string, importance double")
    votes = stats.feature_effects(it, "env", "y", columns)
    for evidence in (rates.select("env", "concept", F.col("selection_rate").alias("rate")), forest, sparse.withColumn("coefficient", F.when(F.abs("coefficient") > 1e-9, F.col("coefficient")).otherwise(0.0))):
        votes = votes.join(F.broadcast(settled(evidence)), ["env", "concept"], "left")  # regions x columns
    return rounded(graph.vote_signals(votes, 5, top_rank=1, rate="rate", importance="importance", coefficient="coefficient"))


@query(
    f"""WITH {ITEMS}, s AS (SELECT stddev_pop(price) AS sp, avg(tax) AS mt, stddev_pop(tax) AS st FROM it), c AS (SELECT g, price AS x, price + g * sp * (tax - mt) / st AS y, sp FROM it, s, (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS g))
SELECT g AS gamma, {r('sqrt(avg(pow((y - x) / sp, 2)))', 'standardized_rmse')} FROM c GROUP BY g"""
)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised error that a known share of a climate score adds."""
    it = items(spark, sf_dir)
    score = stats.ClimateScore(["tax"]).fit(it)
    sd = float(it.agg(F.stddev_pop("price")).first()[0])
    made = it.select("price", *[stats.contaminated("price", F.lit(sd), score.score(), g).alias(f"g{i}") for i, g in enumerate((0.0, 0.5, 1.0, 2.0))])
    out = made.agg(*[stats.standardized_rmse([(F.col(f"g{i}"), F.col("price"), F.lit(sd))]).alias(f"g{i}") for i in range(4)])
    return rounded(out.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gamma"), F.col(f"g{i}").alias("standardized_rmse")) for i, g in enumerate((0.0, 0.5, 1.0, 2.0))]))))


#: The name of a sign: zeros are left out, and what is left must be one.
SIGN_SQL = """CASE WHEN count(partial_corr) = 0 THEN 'unknown' WHEN count(*) FILTER (partial_corr <> 0) = 0 THEN 'zero_or_unknown'
  WHEN count(DISTINCT sign(partial_corr)) FILTER (partial_corr <> 0) > 1 THEN 'mixed' WHEN max(partial_corr) > 0 THEN 'positive' ELSE 'negative' END"""

EDGES_SQL = f"""{ITEMS}, ed AS (
  {' UNION ALL '.join(f"SELECT env::VARCHAR AS environment, '{a}' AS source, '{b}' AS target, '{ga}' AS source_group, '{gb}' AS target_group, {'true' if d else 'false'} AS directed, corr({a}::DOUBLE, {b}::DOUBLE) AS partial_corr FROM it WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY env" for a, b, ga, gb, d in (('qty', 'price', 'geochemistry', 'geochemistry', False), ('tax', 'price', 'climate', 'geochemistry', True), ('disc', 'price', 'climate', 'geochemistry', True), ('qty', 'y', 'geochemistry', 'target', True)))}
), kept AS (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY edge_weight DESC, abs(partial_corr) DESC, source, target) AS rank_in_environment FROM (SELECT *, least(abs(partial_corr) + 0.05, 1.0) AS edge_weight, false AS logistic FROM ed WHERE abs(partial_corr) >= 0.002)), cs AS (
  SELECT CASE WHEN directed THEN source || ' -> ' || target ELSE least(source, target) || ' -- ' || greatest(source, target) END AS edge_key, any_value(source) AS source, any_value(target) AS target, any_value(source_group) AS source_group, any_value(target_group) AS target_group, bool_or(directed) AS directed,
         count(DISTINCT environment) AS env_count, array_to_string(list_sort(list(DISTINCT environment)), ';') AS environments, avg(edge_weight) AS mean_edge_weight, max(edge_weight) AS max_edge_weight, avg(partial_corr) AS mean_partial_corr, avg(abs(partial_corr)) AS mean_abs_partial_corr, {SIGN_SQL} AS partial_corr_sign, {SIGN_SQL} IN ('positive', 'negative') AS sign_consistent,
         count(DISTINCT environment) / 5 AS stable_edge_score, bool_or(coalesce(logistic, false)) AS logistic_any, count(*) FILTER (logistic) AS logistic_count, avg(rank_in_environment) AS mean_rank, min(rank_in_environment) AS min_rank FROM kept GROUP BY 1
)"""


NOTE_SQL = "source_group || CASE WHEN directed THEN ' -> ' ELSE ' -- ' END || target_group || '; ' || env_count || ' of 5 environments; sign ' || partial_corr_sign || CASE WHEN logistic_any THEN '; chosen by the sparse model' ELSE '' END"


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of four column pairs in each region, by correlation."""
    groups = {"qty": "geochemistry", "price": "geochemistry", "tax": "climate", "disc": "climate", "y": "target"}
    pairs = (("qty", "price"), ("price", "tax"), ("price", "disc"), ("qty", "y"))
    sums = items(spark, sf_dir).groupBy("env").agg(*[stats.pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(groups[a]).alias("group_a"), F.lit(groups[b]).alias("group_b"), F.col(f"c{i}").alias("partial_corr")) for i, (a, b) in enumerate(pairs)])
    e = graph.orient(sums.select(F.col("env").cast("string").alias("environment"), F.inline(rows)))
    return graph.strongest_edges(e.withColumns({"selected_by_partial_corr": F.abs("partial_corr") >= 0.002, "selected_by_target_logistic": F.lit(False), "partial_p": F.lit(0.0)}))


@query(
    f"""WITH {EDGES_SQL} SELECT edge_key, source, target, source_group, target_group, directed, env_count, environments, {', '.join(r(c, c) for c in ('mean_edge_weight', 'max_edge_weight', 'mean_partial_corr', 'mean_abs_partial_corr', 'mean_rank'))}, partial_corr_sign, sign_consistent, {r('stable_edge_score', 'stable_edge_score')}, logistic_any, logistic_count, min_rank FROM cs"""
)
def edge_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.edge_consensus(region_edges(spark, sf_dir), 5))


@query(
    f"""WITH {EDGES_SQL}, k AS (SELECT *, CASE WHEN target_group = 'target' AND source_group = 'geochemistry' AND env_count = 5 AND sign_consistent THEN 'stable_mineralization_signal_edge' WHEN target_group = 'target' AND env_count >= 2 AND sign_consistent THEN 'mostly_stable_direct_signal_edge'
  WHEN target_group = 'target' AND source_group IN ('climate', 'terrain') THEN 'environment_or_exposure_sensitive_target_edge' WHEN source_group = target_group THEN 'within_variable_family_edge' WHEN target_group = 'geochemistry' THEN 'candidate_control_on_geochemical_expression' WHEN NOT directed THEN 'undirected_cross_environment_association' ELSE 'other_candidate_edge' END AS edge_class FROM cs)
SELECT row_number() OVER (ORDER BY env_count DESC, edge_class, mean_edge_weight DESC, mean_abs_partial_corr DESC, edge_key)::INT AS position, source, CASE edge_class WHEN 'stable_mineralization_signal_edge' THEN 'stable_signal_for' WHEN 'mostly_stable_direct_signal_edge' THEN 'mostly_stable_signal_for' WHEN 'within_variable_family_edge' THEN 'covaries_with' WHEN 'candidate_control_on_geochemical_expression' THEN 'candidate_modulates' ELSE 'associated_with' END AS relation, target, edge_class, environments,
  {r('stable_edge_score', 'stable_edge_score')}, {r('mean_edge_weight', 'mean_edge_weight')}, CASE WHEN edge_class IN ('within_variable_family_edge', 'undirected_cross_environment_association') THEN 'context' WHEN stable_edge_score >= 1 AND sign_consistent THEN 'high' ELSE 'medium' END AS confidence, 'cross_environment_causal_graph_comparison' AS evidence_type, {NOTE_SQL} AS note FROM k"""
)
def knowledge_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.knowledge_triples(graph.edge_consensus(region_edges(spark, sf_dir), 5), 5))


@query(
    f"""WITH {SPEARMAN_SQL.replace('FROM it WHERE', ', env AS e FROM it WHERE').replace('PARTITION BY target, covariate', 'PARTITION BY e, target, covariate').replace('SELECT target, covariate, rank', 'SELECT e, target, covariate, rank').replace('SELECT target, covariate, count(*)', 'SELECT e, target, covariate, count(*)').replace('GROUP BY target, covariate)', 'GROUP BY e, target, covariate)')},
b AS (SELECT *, row_number() OVER (PARTITION BY e, target ORDER BY abs(spearman) DESC, covariate) AS nth FROM sp)
SELECT covariate AS climate, target, {r('avg((abs(spearman) >= 0.01)::INT)', 'sensitive_rate')}, {r('avg(abs(spearman))', 'mean_abs')}, {r('max(abs(spearman))', 'max_abs')}, count(*) AS n_folds FROM b WHERE nth = 1 GROUP BY covariate, target"""
)
def fold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank screens of each region, summed up over regions."""
    pairs = stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"], by=["env"])
    return rounded(graph.fold_summary(stats.spearman_screen(pairs, 0.01, by=["env"])))


def fusion_sql() -> str:
    """The end of a fusion of j(climate, target, g, m, c): missing m and c are
    0 before each column is scaled, a constant column is 1 everywhere."""
    scaled = lambda c: f"CASE WHEN count({c}) OVER () = 0 THEN 0.0 WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
    return f"""z AS (SELECT climate, target, g::DOUBLE AS g, coalesce(m, 0)::DOUBLE AS m, coalesce(c, 0)::DOUBLE AS c FROM j),
k AS (SELECT *, {scaled('g')} AS gs, {scaled('m')} AS ms, {scaled('c')} AS cs FROM z)
SELECT climate, target, {r('gs', 'global_score')}, {r('ms', 'm4_score')}, {r('cs', 'causal_score')}, {r('0.45 * gs + 0.35 * ms + 0.20 * cs', 'combined_score')},
       coalesce(0.45 * gs + 0.35 * ms + 0.20 * cs >= 0.5, false) AS selected, {r('g', 'global_abs')}, {r('m', 'sensitive_rate')}, {r('c', 'causal_raw')} FROM k"""


@query(
    f"""WITH {SPEARMAN_SQL}, m4 AS (SELECT covariate, target, (abs(spearman) >= 0.002)::INT AS s FROM sp), j AS (SELECT sp.covariate AS climate, sp.target, abs(spearman) AS g, s AS m, CASE WHEN sp.target = 'price' THEN (CASE WHEN sp.covariate = 'tax' THEN 0.8 ELSE 0.4 END)::DOUBLE END AS c FROM sp JOIN m4 ON sp.covariate = m4.covariate AND sp.target = m4.target),
{fusion_sql()}"""
)
def sensitivity_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"]).select(F.col("covariate").alias("climate"), "target", F.abs("spearman").alias("global_abs"))
    m4 = pairs.select("climate", "target", (F.col("global_abs") >= 0.002).cast("int").alias("sensitive_rate"))
    causal = spark.createDataFrame([("tax", "price", 0.8), ("disc", "price", 0.4)], "climate string, target string, causal_score double")
    return rounded(graph.fuse_sensitivity(pairs, m4, causal))


@query(
    f"""WITH {SPEARMAN_SQL}, j AS (
  SELECT covariate AS climate, target, CASE WHEN covariate = 'disc' OR target = 'price' THEN abs(spearman) END AS g, CASE WHEN target = 'price' THEN 0.6 WHEN covariate = 'tax' THEN 1.0 END AS m,
         CASE WHEN covariate = 'tax' AND target = 'price' THEN 0.4 WHEN covariate = 'tax' THEN 0.8 END AS c FROM sp
), {fusion_sql()}"""
)
def sensitivity_fusion_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion where a pair has no global correlation and others no evidence."""
    known = (F.col("covariate") == "disc") | (F.col("target") == "price")
    pairs = stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"]).select(F.col("covariate").alias("climate"), "target", F.when(known, F.abs("spearman")).alias("global_abs"))
    m4 = spark.createDataFrame([("tax", "price", 0.6), ("disc", "price", 0.6), ("tax", "qty", 1.0)], "climate string, target string, sensitive_rate double")
    causal = spark.createDataFrame([("tax", "price", 0.4), ("tax", "qty", 0.8)], "climate string, target string, causal_score double")
    return rounded(graph.fuse_sensitivity(pairs, m4, causal))


@query(
    f"""WITH {SPEARMAN_SQL}, j AS (SELECT covariate AS climate, target, abs(spearman) AS g, CASE WHEN target = 'price' THEN 0.6 ELSE 1.0 END AS m, NULL::DOUBLE AS c FROM sp), f AS ({'WITH ' + fusion_sql()})
SELECT target, min_by(climate, (combined_score IS NULL, -combined_score, climate)) AS best_climate, max(global_abs) AS max_global_abs, max(sensitive_rate) AS max_sensitive_rate, max(causal_raw) AS max_causal_score,
       max(combined_score) AS max_combined_score, bool_or(selected) AS selected FROM f GROUP BY target"""
)
def fused_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a fused graph in which no pair has causal evidence."""
    pairs = stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"]).select(F.col("covariate").alias("climate"), "target", F.abs("spearman").alias("global_abs"))
    m4 = pairs.select("climate", "target", F.when(F.col("target") == "price", 0.6).otherwise(1.0).alias("sensitive_rate"))
    causal = spark.createDataFrame([], "climate string, target string, causal_score double")
    return rounded(graph.target_summary(graph.fuse_sensitivity(pairs, m4, causal)))


ROUGH_EDGES_SQL = f"""{ITEMS}, ed AS (
  {' UNION ALL '.join(f"SELECT env, env::VARCHAR AS environment, '{a}' AS source, '{b}' AS target, '{ga}' AS source_group, '{gb}' AS target_group, {d} AS directed, corr({a}::DOUBLE, {b}::DOUBLE) AS pc FROM it WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY env" for a, b, ga, gb, d in (('qty', 'price', 'geochemistry', 'geochemistry', 'false'), ('tax', 'price', 'climate', 'geochemistry', 'true'), ('disc', 'price', 'climate', 'geochemistry', 'true'), ('qty', 'y', 'geochemistry', 'target', 'true')))}
), rough AS (SELECT *, CASE WHEN source = 'tax' THEN 0.0 WHEN source = 'disc' AND env <> 2 THEN NULL WHEN source = 'disc' THEN 0.0 ELSE CASE WHEN env = 1 THEN 0.0 ELSE pc END END AS partial_corr, source = 'tax' AND env < 2 AS logistic FROM ed),
kept AS (SELECT *, least(coalesce(abs(partial_corr), 0.0) + 0.10 + CASE WHEN logistic THEN 0.05 ELSE 0.0 END, 1.0) AS edge_weight FROM rough),
ranked AS (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY edge_weight DESC, source, target) AS rk FROM kept)"""


def rough_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each region of which some have no partial correlation or 0."""
    groups = {"qty": "geochemistry", "price": "geochemistry", "tax": "climate", "disc": "climate", "y": "target"}
    pairs = (("qty", "price"), ("price", "tax"), ("price", "disc"), ("qty", "y"))
    sums = items(spark, sf_dir).groupBy("env").agg(*[stats.pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(groups[a]).alias("group_a"), F.lit(groups[b]).alias("group_b"), F.col(f"c{i}").alias("pc")) for i, (a, b) in enumerate(pairs)])
    e = graph.orient(sums.select("env", F.col("env").cast("string").alias("environment"), F.inline(rows)))
    disc = F.when(F.col("env") == 2, 0.0)
    pc = F.when(F.col("source") == "tax", 0.0).when(F.col("source") == "disc", disc).when(F.col("env") == 1, 0.0).otherwise(F.col("pc"))
    logistic = (F.col("source") == "tax") & (F.col("env") < 2)
    weight = F.least(F.coalesce(F.abs("partial_corr"), F.lit(0.0)) + 0.10 + F.when(logistic, 0.05).otherwise(0.0), F.lit(1.0))
    w = Window.partitionBy("environment").orderBy(F.desc("edge_weight"), "source", "target")
    return e.withColumn("partial_corr", pc).withColumns({"selected_by_target_logistic": logistic, "edge_weight": weight}).withColumn("rank_in_environment", F.row_number().over(w))


@query(
    f"""WITH {ROUGH_EDGES_SQL} SELECT source, target, count(DISTINCT environment) AS env_count, {r('avg(abs(partial_corr))', 'mean_abs_partial_corr')}, {SIGN_SQL} AS partial_corr_sign, {SIGN_SQL} IN ('positive', 'negative') AS sign_consistent,
  bool_or(logistic) AS logistic_any, count(*) FILTER (logistic) AS logistic_count, {r('avg(rk)', 'mean_rank')}, min(rk) AS min_rank,
  max(CASE WHEN environment = '0' THEN rk END) AS rank_0, bool_or(environment = '9') AS in_9 FROM ranked GROUP BY source, target"""
)
def edge_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus columns of edges with missing, zero and mixed signs."""
    c = graph.edge_consensus(rough_edges(spark, sf_dir), 5, environments=("0", "9"))
    return rounded(
        c.select(
            "source", "target", "env_count", "mean_abs_partial_corr", "partial_corr_sign", "sign_consistent", "logistic_any", "logistic_count", "mean_rank", "min_rank",
            F.col("0_rank").alias("rank_0"), F.col("appears_in_9").alias("in_9"),
        )
    )


@query(
    f"""WITH {SPEARMAN_SQL}, t AS (SELECT target, max(CASE WHEN covariate = 'tax' THEN spearman END) AS s, max(CASE WHEN covariate = 'tax' THEN n_pairs END) AS n FROM sp GROUP BY target)
SELECT target AS target_column, 'zz' AS best_climate_column, {r('s', 'spearman')}, {r('abs(s)', 'spearman_abs_max')}, n AS n_pair_at_best, abs(s) >= 0.005 AS is_spearman_sensitive FROM t"""
)
def spearman_screen_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two covariates of equal correlation: the first column wins, not the first name."""
    it = items(spark, sf_dir).withColumns({"zz": F.col("tax"), "aa": F.col("tax")})
    return rounded(stats.spearman_screen(stats.spearman_pairs(it, ["price", "qty"], ["zz", "aa"]), 0.005, covariates=["zz", "aa"]))


@query(
    f"""WITH v AS (SELECT user_id % 10 AS cell, dayofyear(ts)::INT AS yr, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events), p AS (SELECT unnest([1, 31, 100]) AS a, unnest([30, 120, 366]) AS b)
SELECT cell, a AS first_year, b AS last_year, count(*) AS n_years, count(value) AS n_valid, {r('count(value) / count(*)', 'valid_fraction')}, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')} FROM v JOIN p ON yr BETWEEN a AND b GROUP BY cell, a, b"""
)
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over days of the year stand in for windows over years."""
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("cell"), F.dayofyear("ts").alias("year"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))
    return rounded(series.period_summary(v, [(1, 30), (31, 120), (100, 366)]))


@query(
    """SELECT CASE WHEN c_custkey IS NULL THEN 'left_only' WHEN o_custkey IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM orders FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1"""
)
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return guards.match_report(o, c, ["k"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return guards.with_row_index(o, ["o_orderdate", "o_orderkey"], rows_per_range=5000).select("o_orderkey", F.col("row_index").cast("long").alias("row_index"))


@query(
    f"""WITH {POINTS}, o AS (SELECT id, CASE WHEN id % 50 = 0 THEN 1 - y ELSE y END AS y, lat + CASE WHEN id % 70 = 0 THEN 0.01 ELSE 0 END AS lat, CASE WHEN id % 90 <> 0 THEN lon END AS lon, state FROM pt WHERE id % 40 <> 0),
j AS (SELECT pt.id AS a, o.id AS b, pt.y AS y, o.y AS y2, pt.lat, o.lat AS lat2, pt.lon, o.lon AS lon2, pt.state, o.state AS state2 FROM pt FULL JOIN o ON pt.id = o.id)
SELECT count(*) AS n_keys, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND y IS DISTINCT FROM y2) AS differ_y,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND state IS DISTINCT FROM state2) AS differ_state, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND coalesce(abs(lat - lat2) > 1e-6, (lat IS NULL) <> (lat2 IS NULL))) AS differ_lat,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND coalesce(abs(lon - lon2) > 1e-6, (lon IS NULL) <> (lon2 IS NULL))) AS differ_lon FROM j"""
)
def metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a copy that lacks some and changes labels and places."""
    pt = points(spark, sf_dir)
    k = F.col("id")
    other = pt.where(k % 40 != 0).select(
        "id", F.when(k % 50 == 0, 1 - F.col("y")).otherwise(F.col("y")).alias("y"), (F.col("lat") + F.when(k % 70 == 0, 0.01).otherwise(0.0)).alias("lat"), F.when(k % 90 != 0, F.col("lon")).alias("lon"), "state"
    )
    return audit.metadata_mismatches(pt, other, ["id"], ["y", "state"], ["lat", "lon"])


@query(
    """WITH m AS (SELECT 'labels' AS "table", count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_positive, 9::BIGINT AS want FROM labels)
SELECT "table", 'n_rows' AS field, '9' AS expected, n_rows::VARCHAR AS measured FROM m WHERE n_rows <> 9 UNION ALL SELECT "table", 'n_positive', '7', n_positive::VARCHAR FROM m WHERE n_positive <> 7"""
)
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a (wrong) manifest that the table does not hold."""
    measured = audit.table_shape(table(spark, sf_dir, "labels"), "labels", "quality")
    manifest = spark.createDataFrame([("labels", 9, 3, 7)], "table string, n_rows long, n_columns long, n_positive long")
    return audit.manifest_differences(measured, manifest, ["table"], ["n_rows", "n_columns", "n_positive"])


@query(
    f"""WITH {JUDGED} SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, min_by(row_index, (-p, row_index)) AS best_row, {r('median(p)', 'median_p')}, {r('quantile_cont(p, 0.25)', 'p25')}, count(*) FILTER (p >= 0.5) AS n_high, bool_or(y = 0) AS any_bad FROM jd GROUP BY lang"""
)
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(spark, sf_dir)
    return rounded(
        d.groupBy("lang").agg(
            F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), S.joined_set(F.col("source")).alias("sources"), F.min_by("row_index", F.struct(-F.col("p"), F.col("row_index"))).alias("best_row"),
            F.median("p").alias("median_p"), F.percentile("p", F.lit(0.25)).alias("p25"), F.count_if(F.col("p") >= 0.5).alias("n_high"), F.bool_or(F.col("y") == 0).alias("any_bad"),
        )
    )


@query(
    f"""WITH {ITEMS} SELECT count(*) AS n_rows, 8::BIGINT AS n_columns, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative, count(DISTINCT state) AS n_regions, count(DISTINCT row_index) AS n_keys, count(row_index) - count(DISTINCT row_index) AS n_repeated_keys,
       {r('(avg((qty IS NULL)::INT) + avg((price IS NULL)::INT) + avg((disc IS NULL)::INT) + avg((tax IS NULL)::INT) + avg((env IS NULL)::INT)) / 5', 'mean_missing_rate')} FROM it"""
)
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.dataset_profile(items(spark, sf_dir), "y", "state", "row_index"))


@query(
    f"""WITH {ITEMS}, dr AS (SELECT it.*, i, (row_index * (2 * i + 3) + i * 13) % 3 AS times FROM it, range(12) a(i)), rp AS (SELECT dr.* FROM dr, range(times)),
lg AS ({' UNION ALL '.join(f"SELECT env, i, y, '{c}' AS concept, {c}::DOUBLE AS v FROM rp WHERE {c} IS NOT NULL" for c in ('qty', 'price', 'disc', 'tax'))}),
rk AS (SELECT env, i, concept, y, rank() OVER w + (count(*) OVER (PARTITION BY env, i, concept, v) - 1) / 2.0 AS rk FROM lg WINDOW w AS (PARTITION BY env, i, concept ORDER BY v)),
au AS (SELECT env, i, concept, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM rk GROUP BY env, i, concept),
pl AS (SELECT env, concept, row_number() OVER (PARTITION BY env, i ORDER BY round(abs(auc - 0.5), 12) DESC, concept) AS nth FROM au)
SELECT env, concept, {r('avg((nth <= 2)::INT)', 'selection_rate')}, count(*) AS n_iterations FROM pl GROUP BY env, concept"""
)
def selection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples by a fixed table of weights, so that both engines draw alike."""
    times = lambda i: (F.col("row_index") * (2 * i + 3) + i * 13) % 3
    return rounded(stats.selection_rates(items(spark, sf_dir), "env", "y", Z_COLUMNS, times, iterations=12, top_k=2))


@query(
    f"""WITH {SPEARMAN_SQL} SELECT {r("avg(spearman)", 'mean_spearman')}, count(spearman) AS n_features FROM sp WHERE (target, covariate) IN (('price', 'disc'), ('qty', 'tax'))"""
)
def mean_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mean_feature_spearman(items(spark, sf_dir), {"price": "disc", "qty": "tax"}))


@query()
def discovered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-correlation and sparse-model edges of each region; the sparse
    solver is the engine's own, so there is no SQL."""
    groups = {"qty": "geochemistry", "price": "geochemistry", "disc": "climate", "tax": "climate", "y": "target"}
    return experiments.discover_edges(settled(items(spark, sf_dir)), "env", "y", ["qty", "price", "disc", "tax"], groups)


@query()
def forest_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes with a forest of 300 trees in grouped folds; learners differ by
    engine, so there is no SQL: the tests hold coverage and leakage instead."""
    columns = ["qty", "price", "disc", "tax"]
    it = items(spark, sf_dir).select("row_index", "y", "state", *[F.col(c).cast("double").alias(c) for c in columns])
    folds = settled(splits.group_kfold(it, "state", 3))
    sets = {"full": columns, "no_climate": ["qty", "price"], "core_geo": ["qty", "price"], "climate_adjusters": ["disc", "tax"], "geochemistry": ["qty", "price"]}
    models = linear.fit_folds(folds, columns, "y")
    recipes = {n: {f: recipe.columns_of(n, sets, set(), set()) for f in models.grams} for n in ("Full", "NoClimate", "M3_Broad")}
    oof = forest_of_cells.out_of_fold(models, folds, "row_index", recipes, sets["climate_adjusters"])
    return experiments.coverage(oof, folds, "row_index").join(evaluate.classification_metrics(oof, ["model"]), "model")


@query()
def balanced_by_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = points(spark, sf_dir).select("id", "y", "lat", "lon")
    return learners.smote_like(pt, ["lat", "lon"], "y", "id")
