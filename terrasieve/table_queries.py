"""Queries of readers, writers, guards and small operators, and their SQL.

Each writes what it reads below the shared folder first, so that it runs on
any store, and returns what came back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import files
from .functions import scalars as S
from .functions.lineage import scratch, settled
from .operators import catalog, evaluate, graph, guards, spatial, splits, stats
from .plans import recipe
from .queries import EDGES_SQL, EFFECTS_SQL, ITEMS, POINTS, SPEARMAN_SQL, fusion_sql, items, km_sql, points, query, r, region_edges, rounded, table
from .sources import audit, readers, sinks


@query("SELECT p_partkey, p_size, p_retailprice, p_type FROM part WHERE p_size > 3")
def csv_and_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV, read by suffix with a schema and pruned, written
    as Parquet with NaN for a missing value, and read again."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size"), "p_retailprice", "p_type")
    a, b = scratch(spark, "part") + ".csv", scratch(spark, "part") + ".parquet"
    sinks.write_table(part, a)
    back = readers.read_table(spark, a, schema="p_partkey long, p_size int, p_retailprice double, p_type string")
    sinks.write_table(back.withColumn("odd", F.when(F.col("p_size") > 3, F.lit(1.0)).otherwise(F.lit(float("nan")))), b)
    return readers.read_table(spark, b, columns=["p_partkey", "p_size", "p_retailprice", "p_type", "odd"]).where("odd is not null").drop("odd")


@query(
    """SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment || '名' AS segment, 'utf-8|gb18030' AS encodings, ';' AS delimiter, (SELECT count(*) + 1 FROM customer) AS physical_rows FROM customer"""
)
def sniffed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of unknown encoding and delimiter, written in both of two, of
    which the second comes back; heads alone are sniffed."""
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat("c_mktsegment", F.lit("名"))).alias("value"))
    found, path = [], ""
    lines = spark.createDataFrame([("c_custkey;segment",)], "value string").unionByName(rows).coalesce(1)  # one file, its header first
    for encoding in ("utf-8", "gb18030"):
        folder = scratch(spark, "sniff")
        coded = F.pandas_udf(lambda col, e=encoding: col.map(lambda v: v.encode(e)), "binary")
        lines.select(coded("value").cast("string").alias("value")).write.text(folder)
        path = next(f for f in files.files_below(spark, folder) if "part-" in f)
        found.append(readers.sniff_csv(spark, path))
    back = readers.read_sniffed_csv(spark, path)
    n = readers.count_csv_rows(spark, path)
    return back.withColumns({"encodings": F.lit("|".join(f["encoding"] for f in found)), "delimiter": F.lit(found[-1]["delimiter"]), "physical_rows": F.lit(n)})


@query("SELECT n_nationkey AS year, n_regionkey AS cell_0, n_name AS name FROM nation")
def commented_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated text with comments and an unnamed column."""
    path = scratch(spark, "commented")
    lines = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), "n_name", F.lit("x")).alias("value")).collect()
    files.write_text(spark, path, "# a note\nyear\tcell_0\tname\tUnnamed: 3\n" + "".join(row["value"] + "\n" for row in lines))
    return readers.read_commented_tsv(spark, path)


@query(
    f"""WITH v AS (SELECT dayofyear(ts)::INT AS year, round(sum(value), 3) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT year, 0 AS cell, {r('CASE WHEN n % 5 <> 0 THEN v END', 'value')} FROM v UNION ALL SELECT year, 1, {r('n', 'value')} FROM v"""
)
def fixed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space separated numbers with a sentinel, read in long form."""
    path = scratch(spark, "grid")
    daily = table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("year")).agg(F.round(F.sum("value"), 3).alias("v"), F.count("*").alias("n"))
    cell = F.when(F.col("n") % 5 != 0, F.col("v")).otherwise(-99.999)
    daily.select(F.concat_ws("   ", F.col("year").cast("string"), F.format_string("%.3f", cell), F.col("n").cast("string")).alias("value")).write.text(path)
    return rounded(readers.read_fixed_grid(spark, path))


@query(
    """SELECT '1:' || k AS ratio, count(*) AS n_rows FROM supplier, (SELECT unnest([5, 10, 20]) AS k) WHERE s_suppkey % k = 0 GROUP BY k
UNION ALL SELECT 'manifest', count(*) FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT 'discovered', count(*) FROM supplier WHERE s_suppkey % 10 = 0"""
)
def discovered_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found by the ratio in their path, by a manifest, and by search."""
    root, su = scratch(spark, "runs"), table(spark, sf_dir, "supplier")
    for k in (5, 10, 20):
        su.where(F.col("s_suppkey") % k == 0).write.parquet(f"{root}/ratio_1_{k}/data.parquet")
    parts = []
    for path in readers.ratio_datasets(spark, root, [5, 10, 20]).values():
        parts.append(spark.read.parquet(path).groupBy(readers.ratio_label(F.input_file_name()).alias("ratio")).agg(F.count("*").alias("n_rows")))
    sinks.write_manifest(spark, {"input_path": f"{root}/ratio_1_10/data.parquet"}, f"{root}/run_manifest.json")
    named = readers.discover_dataset(spark, root)
    searched = readers.discover_dataset(spark, f"{root}/ratio_1_10")
    for name, path in (("manifest", named), ("discovered", searched)):
        parts.append(readers.read_table(spark, path).agg(F.lit(name).alias("ratio"), F.count("*").alias("n_rows")))
    return guards.union_all(parts)


@query("""SELECT r_regionkey, r_name, NULL::VARCHAR AS nothing, r_regionkey * 2 AS twice, '{"a.b":1,"a.c.d":[2],"e":"x"}' AS flat FROM region""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with nulls written out, and a configuration flattened."""
    import json

    path, config = scratch(spark, "lines"), scratch(spark, "config") + ".json"
    df = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("nothing"), (F.col("r_regionkey") * 2).alias("twice"))
    sinks.write_json_lines(df, path)
    sinks.write_manifest(spark, {"a": {"b": 1, "c": {"d": [2]}}, "e": "x"}, config)
    flat = json.dumps(readers.flatten_paths(readers.load_config(spark, config)), separators=(",", ":"))
    return spark.read.schema("r_regionkey long, r_name string, nothing string, twice long").json(path).withColumn("flat", F.lit(flat))


@query(
    """SELECT '| r_name | size |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || replace(r_name, 'A', chr(92) || '|') || ' | ' || printf('%.4f', r_regionkey / 3.0::DOUBLE) || ' |' FROM region
UNION ALL SELECT 'flowchart LR' UNION ALL SELECT '    ' || replace(n_name, ' ', '_') || '["' || n_name || '"] -->|' || printf('%.3f', n_regionkey / 4.0::DOUBLE) || '| x["x"]' FROM (SELECT * FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 24)"""
)
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table with escaped pipes, and a flowchart of 24 edges."""
    small = table(spark, sf_dir, "region").select(F.replace("r_name", F.lit("A"), F.lit("|")).alias("r_name"), (F.col("r_regionkey") / 3.0).alias("size"))
    edges = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.lit("x").alias("target"), (F.col("n_regionkey") / 4.0).alias("edge_weight"))
    text = sinks.markdown_table(small) + "\n" + sinks.mermaid_flowchart(edges)
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query(
    "SELECT 'part-' || lpad((r_regionkey)::VARCHAR, 2, '0') AS name, length('region ' || r_name || ' /home/x') + 1 AS n_bytes, sha256('region ' || r_name || ' /home/x' || chr(10)) AS sha256, CASE WHEN r_regionkey = 1 THEN 'changed' WHEN r_regionkey = 2 THEN 'unlisted' END AS problem, r_regionkey = 3 AS too_large, '/home/' AS pattern FROM region UNION ALL SELECT 'part-99', NULL, NULL, 'missing', NULL, NULL"
)
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, checksums, forbidden paths and differences from a list of files."""
    root = scratch(spark, "files")
    for row in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        files.write_text(spark, f"{root}/part-{row['r_regionkey']:02d}", f"region {row['r_name']} /home/x\n")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    info = audit.file_info(spark, root).select(name.alias("name"), F.col("length").alias("n_bytes"), "sha256")
    listed = info.select("name", F.when(F.col("name") == "part-01", F.lit("0")).otherwise(F.col("sha256")).alias("sha256")).where("name <> 'part-02'").unionByName(spark.createDataFrame([("part-99", "1")], "name string, sha256 string"))
    problems = audit.checksum_differences(info, listed)
    largest = info.agg(F.max(F.struct(F.col("name") == "part-03", "n_bytes"))["n_bytes"].alias("most"))
    large = info.crossJoin(F.broadcast(largest)).select("name", (F.col("name") == "part-03").alias("too_large"))
    paths = audit.lines_matching(spark, root, ["/home/", "/Users/"]).select(name.alias("name"), "pattern")
    return info.join(problems, "name", "full").join(large, "name", "left").join(paths, "name", "left")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def contract_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins under contracts: many to one and complete, then one to one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    guards.expect_no_missing(o, ["k", "o_totalprice"])
    guards.expect_subset(o, c, ["k"])
    joined = guards.contract_join(o, c, ["k"], complete=True).select("o_orderkey", "c_name", "o_totalprice")
    guards.expect_same_rows(joined.select("o_orderkey"), o.select("o_orderkey"))
    return guards.contract_join(joined.select("o_orderkey", "c_name"), o.select("o_orderkey", "o_totalprice"), ["o_orderkey"], contract="one_to_one", complete=True)


@query(
    """SELECT 'by_key' AS how, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL
SELECT 'by_position', a.k, b.v FROM (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a JOIN (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer) b USING (n)"""
)
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows met by key where both sides hold it once, else by position."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    left = guards.with_row_index(c.select("id"), ["id"])
    right = guards.with_row_index(c, ["v", "id"])
    keyed = guards.align(left, right, "id").select(F.lit("by_key").alias("how"), "id", "v")
    return keyed.unionByName(guards.align(left, right.withColumn("id", F.lit(0).cast("long")), "id").select(F.lit("by_position").alias("how"), "id", "v"))


@query(
    f"""WITH {POINTS}, f AS (SELECT segment, arg_min(id, (bal, id)) AS first_id FROM pt GROUP BY segment), s AS (SELECT count(*) AS n FROM (SELECT id FROM pt WHERE y = 1 EXCEPT SELECT id FROM pt WHERE state % 2 = 0))
SELECT segment, first_id, n AS n_difference, row_number() OVER (ORDER BY segment DESC) AS place, substr(segment, length('AUTO') + 1) AS tail FROM (SELECT segment, first_id FROM f ORDER BY segment DESC LIMIT 3), s WHERE segment LIKE 'AUTO%'
UNION ALL SELECT segment, first_id, n, row_number() OVER (ORDER BY segment DESC), segment FROM (SELECT segment, first_id FROM f ORDER BY segment DESC LIMIT 3), s WHERE segment NOT LIKE 'AUTO%'"""
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key, a difference of sets, a sort with a limit,
    and a prefix taken off once."""
    pt = points(spark, sf_dir)
    first = guards.first_by(pt.select("segment", "bal", "id"), ["segment"], ["bal", "id"]).select("segment", F.col("id").alias("first_id"))
    n = pt.where("y = 1").select("id").exceptAll(pt.where("state % 2 = 0").select("id")).count()
    top = first.orderBy(F.desc("segment")).limit(3)
    numbered = guards.with_row_index(top, [F.desc("segment")], "place").withColumn("place", F.col("place") + 1)
    return numbered.select("segment", "first_id", F.lit(n).alias("n_difference"), "place", S.strip_prefix(F.col("segment"), "AUTO").alias("tail"))


@query(
    f"""WITH {POINTS} SELECT id, round_even(bal, 0) + 0.0 AS even, abs(bal - round(bal, 1)) <= 1e-8 + 1e-5 * abs(round(bal, 1)) AS close, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN id::DOUBLE ELSE NULL END AS number, regexp_extract(name, '0*(\\d+)$', 1) AS digits FROM pt"""
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-even rounding, tolerance, text that is no number, and a pattern."""
    pt = points(spark, sf_dir)
    text = F.when(F.col("id") % 3 == 0, "n/a").when(F.col("id") % 3 == 1, F.col("id").cast("string")).otherwise("NaN")
    return pt.select(
        "id", (S.round_half_even(F.col("bal"), 0) + 0.0).alias("even"), S.is_close(F.col("bal"), F.round("bal", 1)).alias("close"), S.to_number(text).alias("number"), F.regexp_extract("name", r"0*(\d+)$", 1).alias("digits")
    )


def t_sql(t: str, dof: int) -> str:
    """Two-sided p of Student's t for an even number of degrees of freedom."""
    terms, coefficient = [], 1.0
    for i in range(dof // 2):
        terms.append(f"{coefficient!r}::DOUBLE * pow({dof} / ({dof} + {t} * {t}), {i})")
        coefficient *= (2 * i + 1) / (2 * i + 2)
    return f"1 - abs({t}) / sqrt({dof} + {t} * {t}) * ({' + '.join(terms)})"


@query(
    f"""WITH {ITEMS}, c AS (SELECT env, corr(qty::DOUBLE, tax::DOUBLE) AS r FROM it GROUP BY env), t AS (SELECT env, r * 300 AS t FROM c)
SELECT env, 4 AS dof, {r(t_sql('t', 4), 'p')} FROM t UNION ALL SELECT env, 12, {r(t_sql('t', 12), 'p')} FROM t"""
)
def t_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of scaled correlations; SQL has the finite sum that holds
    for even degrees of freedom."""
    rows = items(spark, sf_dir).groupBy("env").agg((F.corr(F.col("qty").cast("double"), F.col("tax").cast("double")) * 300).alias("t")).collect()
    out = [(x["env"], dof, stats.student_t_two_sided(x["t"], dof)) for x in rows for dof in (4, 12)]
    return rounded(spark.createDataFrame(out, f"env {dict(items(spark, sf_dir).dtypes)['env']}, dof int, p double"))


@query(
    f"""WITH {POINTS}, s AS (SELECT (SELECT least(5, count(*) FILTER (y = 1), count(*) FILTER (y = 0)) FROM pt) AS n_splits),
h AS (SELECT id, state, row_number() OVER (PARTITION BY state ORDER BY id * 17 % 1013, id) AS rn, count(*) OVER (PARTITION BY state) AS n FROM pt)
SELECT id, n_splits, (state % 4)::INT AS frozen, test_fold, state % 4 = test_fold AS is_test FROM h, s, (SELECT unnest([0, 1, 2, 3])::INT AS test_fold) WHERE rn <= n // 2"""
)
def frozen_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each state's rows, folds of a published table, and each row
    once for every fold as training or test row."""
    pt = points(spark, sf_dir)
    half = splits.stratified_half(pt.select("id", "state"), ["state"], [F.col("id") * 17 % 1013, "id"])
    published = pt.select("state", (F.col("state") % 4).cast("int").alias("frozen")).distinct()
    folds = splits.frozen_folds(half, published, ["state"])
    return splits.train_test(folds, range(4), "frozen").select("id", F.lit(splits.usable_splits(pt, "y")).cast("long").alias("n_splits"), "frozen", "test_fold", "is_test")


#: Columns of the line items, their role, and every how many orders lack it.
GAPPED = (
    ("l_orderkey", "geo_structure", 0), ("l_partkey", "geo_structure", 3), ("l_suppkey", "geo_structure", 13), ("l_linenumber", "geo_structure", 4), ("l_quantity", "geochemistry", 7),
    ("l_extendedprice", "geochemistry", 11), ("l_discount", "climate", 5), ("l_tax", "climate", 9), ("l_shipdate", "geochemistry", 6), ("l_returnflag", "geochemistry", 8), ("l_linestatus", "geochemistry", 0),
)


def gapped_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role catalogue of line items of which some orders lack columns."""
    li = table(spark, sf_dir, "lineitem")
    gaps = [F.when(F.col("l_orderkey") % n != 0, F.col(c)).alias(c) if n else F.col(c) for c, _, n in GAPPED]
    return catalog.role_catalog(li.select(*gaps), tuple(catalog.RoleRule("exact", c, role) for c, role, _ in GAPPED))


GAPPED_SQL = "gc AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS col, '{role}' AS role, avg(({c} IS NULL{f' OR l_orderkey % {n} = 0' if n else ''})::INT)::DOUBLE AS missing_rate, count(DISTINCT {f'CASE WHEN l_orderkey % {n} <> 0 THEN {c} END' if n else c}) AS n_unique FROM lineitem"
    for i, (c, role, n) in enumerate(GAPPED)
) + ")"


@query(
    f"""WITH {GAPPED_SQL}, q AS (SELECT quantile_cont(missing_rate, 0.25) AS a, quantile_cont(missing_rate, 0.5) AS b, quantile_cont(missing_rate, 0.75) AS d FROM gc),
p AS (SELECT *, (missing_rate > a)::INT + (missing_rate > b)::INT + (missing_rate > d)::INT AS quartile FROM gc, q), f AS (SELECT unnest(range(5))::INT AS fold),
ch AS (SELECT fold, col, quartile FROM p, f WHERE role = 'geochemistry' AND n_unique > fold AND (missing_rate * 100)::INT % 5 <> fold), w AS (SELECT fold, quartile, count(*) AS n FROM ch GROUP BY ALL),
o AS (SELECT fold, rp.i::INT AS repeat, col, quartile, n, row_number() OVER (PARTITION BY fold, rp.i, quartile ORDER BY (position * (2 * rp.i + 7) + fold * 5 + rp.i * rp.i) % 101, col) AS rn FROM p JOIN w USING (quartile), range(100) rp(i))
SELECT fold, repeat, col AS "column", quartile FROM o WHERE rn <= n"""
)
def matched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the columns that each fold chose, 100 times as many random ones of
    the same quartiles of missing rate, from the catalogue of a table."""
    cat = settled(gapped_catalog(spark, sf_dir))
    chosen = cat.where("role = 'geochemistry'").crossJoin(spark.range(5).select(F.col("id").cast("int").alias("fold")))
    chosen = chosen.where((F.col("n_unique") > F.col("fold")) & (F.round(F.col("missing_rate") * 100).cast("int") % 5 != F.col("fold"))).select("fold", "column")
    i = F.col("repeat")
    return splits.matched_repeats(cat, settled(chosen), 100, (F.col("position") * (2 * i + 7) + F.col("fold") * 5 + i * i) % 101)


@query(
    f"""WITH {EDGES_SQL} SELECT CASE WHEN source_group = 'climate' THEN source ELSE target END AS climate, CASE WHEN source_group = 'climate' THEN target ELSE source END AS target, {r('max(stable_edge_score)', 'causal_score')}
FROM cs WHERE (source_group = 'climate') <> (target_group = 'climate') GROUP BY ALL"""
)
def climate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the regions with one climate end, the strongest of a pair."""
    return rounded(graph.climate_projection(graph.edge_consensus(region_edges(spark, sf_dir), 5)))


CONCEPTS = {"l_quantity": "qty", "l_linenumber": "qty", "l_extendedprice": "price", "l_returnflag": "price", "l_discount": "disc", "l_tax": "tax"}


@query(
    f"""WITH {SPEARMAN_SQL}, {EDGES_SQL.removeprefix(ITEMS + ", ")}, {GAPPED_SQL}, cp AS (SELECT source AS covariate, target, max(stable_edge_score) AS c FROM cs WHERE source_group = 'climate' AND target_group <> 'climate' GROUP BY ALL),
j AS (SELECT sp.covariate AS climate, sp.target, abs(spearman) AS g, (abs(spearman) >= 0.002)::INT AS m, c FROM sp LEFT JOIN cp ON cp.covariate = sp.covariate AND cp.target = sp.target), f AS ({'WITH ' + fusion_sql()}),
mp(feature_name, concept) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in CONCEPTS.items())})
SELECT feature_name, concept, role, position FROM mp JOIN gc ON feature_name = col WHERE n_unique > 2 AND role IN ('geochemistry', 'geo_structure') AND concept IN (SELECT target FROM f WHERE selected)"""
)
def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw columns of the line items that the selected edges of their graph
    reach and that can be residualised."""
    pairs = stats.spearman_pairs(items(spark, sf_dir), ["price", "qty"], ["disc", "tax"]).select(F.col("covariate").alias("climate"), "target", F.abs("spearman").alias("global_abs"))
    pairs = settled(pairs)
    m4 = pairs.select("climate", "target", (F.col("global_abs") >= 0.002).cast("int").alias("sensitive_rate"))
    fused = graph.fuse_sensitivity(pairs, m4, graph.climate_projection(graph.edge_consensus(region_edges(spark, sf_dir), 5)))
    mapping = spark.createDataFrame(list(CONCEPTS.items()), "feature_name string, concept string")
    return graph.graph_targets(fused, mapping, gapped_catalog(spark, sf_dir))


@query(
    f"""WITH {SPEARMAN_SQL}, se AS (SELECT CASE target WHEN 'qty' THEN 'l_quantity' ELSE 'l_extendedprice' END AS col, max(abs(spearman)) >= 0.004 AS hot FROM sp GROUP BY target),
v(name, col, i) AS (VALUES ('full', 'l_quantity', 0), ('full', 'l_extendedprice', 1), ('full', 'l_discount', 2), ('full', 'l_tax', 3), ('no_climate', 'l_quantity', 0), ('no_climate', 'l_extendedprice', 1), ('core_geo', 'l_quantity', 0), ('core_geo', 'l_extendedprice', 1), ('geochemistry', 'l_quantity', 0), ('geochemistry', 'l_extendedprice', 1)),
a AS (SELECT * FROM v UNION ALL SELECT CASE WHEN hot THEN 'M4_Spearman residual' ELSE 'M4_Spearman raw' END, col, (col <> 'l_quantity')::INT FROM se)
SELECT name, string_agg(col, ',' ORDER BY i) AS columns FROM a GROUP BY name"""
)
def role_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets of a role catalogue, in its order, and the recipe that the
    rank screen of the rows makes of them."""
    rule = catalog.RoleRule
    rules = (rule("contains", "price", "geochemistry"), rule("exact", "l_quantity", "geochemistry"), rule("prefix", "l_disc", "climate"), rule("exact", "l_tax", "climate"))
    cat = catalog.role_catalog(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), rules)
    sets = catalog.feature_sets(cat)
    names = {"qty": "l_quantity", "price": "l_extendedprice"}
    found = {names[c] for c in recipe.sensitive_columns(items(spark, sf_dir), ["qty", "price"], ["disc", "tax"], 0.004)}
    raw, residual = recipe.columns_of("M4_Spearman", sets, found)
    named = {k: v for k, v in (sets | {"M4_Spearman raw": raw, "M4_Spearman residual": residual}).items() if v}
    return spark.createDataFrame([(k, ",".join(v)) for k, v in named.items()], "name string, columns string")


@query(
    f"""WITH {POINTS}, q AS (SELECT id, CASE WHEN id % 4 <> 0 THEN bal END AS "Balance", y AS "LABEL" FROM pt)
SELECT count(*) AS n_rows, count("Balance") AS balance_valid, count(*) FILTER ("Balance" > 0) AS balance_positive, count("LABEL") AS label_valid, count(*) FILTER ("LABEL" > 0) AS label_positive FROM q"""
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and positive values of columns named in any case."""
    from .operators import series

    q = points(spark, sf_dir).select("id", F.when(F.col("id") % 4 != 0, F.col("bal")).alias("Balance"), F.col("y").alias("LABEL"))
    return series.quality_summary(q, {"balance": ("bal", "BALANCE"), "label": ("label",)})


@query(
    f"""WITH {POINTS}, k AS (
  SELECT y, state, 'id' AS kind, (id % 97)::VARCHAR AS key FROM pt UNION ALL SELECT y, state, 'coordinate', lat::DECIMAL(9, 2)::VARCHAR || ',' || lon::DECIMAL(9, 2)::VARCHAR FROM pt
  UNION ALL SELECT y, state, 'source', CASE WHEN y = 1 THEN 'p=' || (id % 31)::VARCHAR ELSE 'n=' || (id % 37)::VARCHAR END FROM pt UNION ALL SELECT y, state, 'positive_name', regexp_replace(lower(trim(segment)), '[^a-z0-9]+', '', 'g') FROM pt WHERE y = 1),
g AS (SELECT kind, key, count(*) AS n, min(y) AS l0, max(y) AS l1, min(state) AS r0, max(state) AS r1 FROM k GROUP BY kind, key HAVING count(*) > 1)
SELECT kind, count(*) AS n_groups, sum(n)::BIGINT AS n_rows, count(*) FILTER (l0 <> l1) AS n_label_conflicts, count(*) FILTER (r0 <> r1) AS n_cross_region FROM g GROUP BY kind"""
)
def duplicate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by all four kinds of key: id, place, source by class, and
    the name of positive rows."""
    key = lambda c: F.col(c).cast("decimal(9,2)").cast("string")
    positive = F.col("y") == 1
    kinds = {
        "id": (F.col("id") % 97).cast("string"),
        "coordinate": F.concat_ws(",", key("lat"), key("lon")),
        "source": F.when(positive, F.concat(F.lit("p="), (F.col("id") % 31).cast("string"))).otherwise(F.concat(F.lit("n="), (F.col("id") % 37).cast("string"))),
        "positive_name": F.when(positive, S.normalised_name(F.col("segment"))),
    }
    return evaluate.duplicate_audit(points(spark, sf_dir), kinds, "y", "state")


@query(
    f"""WITH {POINTS}, pf AS (SELECT *, (state % 5)::INT AS fold FROM pt), d AS (SELECT a.id, a.fold, {km_sql('a', 'b')} AS km, a.y = b.y AS same FROM pf a JOIN pf b ON a.fold <> b.fold)
SELECT id, fold, round(min(km), 4) + 0.0 AS any_km, round(min(km) FILTER (same), 4) + 0.0 AS same_label_km, round(min(km) FILTER (NOT same), 4) + 0.0 AS opposite_label_km FROM d GROUP BY id, fold"""
)
def label_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the nearest row of other folds: any, of the same label, of
    the other."""
    pf = points(spark, sf_dir).withColumn("fold", (F.col("state") % 5).cast("int"))
    return rounded(spatial.label_neighbours(pf, "fold", "id", "y"), 4)


@query(
    f"""WITH {ITEMS}, k AS (SELECT 'M2' AS model, row_index, env AS fold, qty / 50.0::DOUBLE AS p FROM it UNION ALL SELECT 'M4', row_index, env, tax FROM it WHERE env <> 3)
SELECT model, count(*) AS n_rows, count(DISTINCT row_index) AS n_keys, (SELECT count(DISTINCT row_index) FROM it) - count(DISTINCT row_index) AS n_missing FROM k GROUP BY model"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and keys that each model's predictions cover, after a check that a
    published mean is what the folds give."""
    from .plans import experiments

    it = items(spark, sf_dir)
    two = it.select(F.lit("M2").alias("model"), "row_index", "env", (F.col("qty") / 50.0).alias("p")).unionByName(it.where("env <> 3").select(F.lit("M4").alias("model"), "row_index", "env", F.col("tax").alias("p")))
    folds = two.groupBy("model", "env").agg(F.avg("p").alias("m"))
    mean = folds.where("model = 'M2'").agg(F.avg("m")).first()[0]
    guards.expect_metric(folds, "M2", "m", float(mean))
    return experiments.coverage(two, it, "row_index")


@query(
    f"""WITH {ITEMS}, lg AS ({' UNION ALL '.join(f"SELECT row_index, env, y, '{c}' AS concept, {c}::DOUBLE AS v FROM it WHERE {c} IS NOT NULL" for c in ('qty', 'price', 'disc', 'tax'))}),
dr AS (SELECT env, concept, v, i, sum(t * y) AS p, sum(t * (1 - y)) AS n FROM (SELECT lg.*, i, (row_index * (2 * i + 7) + i * i) % 101 % 3 AS t FROM lg, range(100) a(i)) GROUP BY env, concept, v, i HAVING sum(t) > 0),
bl AS (SELECT env, concept, i, p, n, coalesce(sum(n) OVER (PARTITION BY env, concept, i ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM dr),
au AS (SELECT env, concept, i, sum(p * (nb + n / 2)) / (sum(p) * sum(n)) AS auc FROM bl GROUP BY env, concept, i),
pl AS (SELECT env, concept, row_number() OVER (PARTITION BY env, i ORDER BY round(abs(auc - 0.5), 12) DESC, list_position(['qty', 'price', 'disc', 'tax'], concept)) AS nth FROM au)
SELECT env, concept, {r('avg((nth <= 2)::INT)', 'selection_rate')}, count(*) AS n_iterations FROM pl GROUP BY env, concept"""
)
def selection_rates_of_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's own number of resamples, all of them different."""
    times = lambda i: (F.col("row_index") * (2 * i + 7) + i * i) % 101 % 3
    return rounded(stats.selection_rates(items(spark, sf_dir), "env", "y", ["qty", "price", "disc", "tax"], times, top_k=2))


EVIDENCE = (("qty", 0.6, 0.0), ("price", 0.2, 0.4), ("disc", None, None), ("tax", 0.5, 0.0))


@query(
    f"""WITH {EFFECTS_SQL}, ev(concept, rate, coefficient) AS (VALUES {', '.join(f"('{c}', {'NULL' if a is None else a}::DOUBLE, {'NULL' if b is None else b}::DOUBLE)" for c, a, b in EVIDENCE)}),
vt AS (SELECT ef.*, auc_strength >= 0.9 OR coalesce(rate >= 0.5, false) OR coalesce(coefficient <> 0 AND env <> 2, false) OR coalesce(rank() OVER (PARTITION BY env ORDER BY round(missing_rate, 9) DESC) <= 1, false) AS sel FROM ef JOIN ev USING (concept)),
g AS (SELECT concept, count(*) FILTER (sel) AS n_selected, coalesce(array_to_string(list_sort(list_distinct(list(env::VARCHAR) FILTER (sel))), ';'), '') AS environments, avg(auc) AS mean_auc, count(DISTINCT CASE WHEN sel THEN direction END) AS dirs FROM vt GROUP BY concept)
SELECT concept, n_selected, environments, {r('mean_auc', 'mean_auc')}, {r('n_selected / 5', 'stable_score')}, dirs = 1 AS direction_consistent,
       CASE WHEN n_selected >= 5 AND dirs = 1 THEN 'cross_environment_stable_signal' WHEN n_selected / 5 >= 2 / 3 AND dirs = 1 THEN 'mostly_stable_signal' WHEN n_selected > 0 AND dirs <> 1 THEN 'environment_sensitive_or_direction_conflict' WHEN n_selected > 0 THEN 'environment_specific_signal' ELSE 'not_selected_in_main_environments' END AS signal_class,
       n_selected >= 2 AS is_candidate FROM g"""
)
def signal_votes_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of evidence: AUC, selection rate, importance rank and a
    sparse model's coefficient, missing ones counting against a concept."""
    e = stats.feature_effects(items(spark, sf_dir), "env", "y", ["qty", "price", "disc", "tax"])
    known = spark.createDataFrame(list(EVIDENCE), "concept string, rate double, coefficient double")
    e = e.join(known, "concept").withColumns({"coefficient": F.when(F.col("env") != 2, F.col("coefficient")), "missing": F.round("missing_rate", 9)})
    return rounded(graph.vote_signals(e, 5, auc_threshold=0.9, top_rank=1, rate="rate", importance="missing", coefficient="coefficient"))


NODES = ("qty", "price", "tax")


def partial_sql(a: str, b: str, c: str) -> str:
    """Partial correlation of two columns given a third, by ridge of 1."""
    wa, wb = f"(sxy_{a}_{c} / (sxy_{c}_{c} + 1))", f"(sxy_{b}_{c} / (sxy_{c}_{c} + 1))"
    cross = lambda x, y, wx, wy: f"(sxy_{x}_{y} - {wx} * sxy_{y}_{c} - {wy} * sxy_{x}_{c} + {wx} * {wy} * sxy_{c}_{c})"
    return f"SELECT env::VARCHAR AS env, '{a}' AS a, '{b}' AS b, n, {cross(a, b, wa, wb)} / sqrt({cross(a, a, wa, wa)} * {cross(b, b, wb, wb)}) AS rho FROM s"


@query(
    f"""WITH {ITEMS}, md AS (SELECT env, {', '.join(f'median({c}) AS m_{c}' for c in NODES)} FROM it GROUP BY env), f AS (SELECT env, {', '.join(f'coalesce({c}, m_{c})::DOUBLE AS {c}' for c in NODES)} FROM it JOIN md USING (env)),
s AS (SELECT env, count(*) AS n, {', '.join(f'count(*) * corr({x}, {y}) AS sxy_{x}_{y}' for x in NODES for y in NODES)} FROM f GROUP BY env),
p AS ({partial_sql('qty', 'price', 'tax')} UNION ALL {partial_sql('qty', 'tax', 'price')} UNION ALL {partial_sql('price', 'tax', 'qty')})
SELECT env, a, b, {r('rho', 'partial_corr')}, abs(rho) >= 0.005 AND abs(rho) * sqrt((n - 3) / (1 - rho * rho)) >= 1.2817 AS selected FROM p"""
)
def partial_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial correlations of all pairs in each environment, and which are
    large and sure enough (a p of 0.2 is a t of 1.28 for so many rows)."""
    rows = graph.partial_edges(items(spark, sf_dir), "env", NODES, threshold=0.005)
    return rounded(spark.createDataFrame([(str(e), a, b, rho, ok) for e, a, b, rho, _, ok in rows], "env string, a string, b string, partial_corr double, selected boolean"))
