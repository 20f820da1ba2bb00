"""Edge cases of the operators: nulls, ties, one class, constants, keys."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasieve.functions import scalars as S
from terrasieve.functions.lineage import settled
from terrasieve.operators import catalog, evaluate, graph, guards, neighbours, series, spatial, splits, stats
from terrasieve.plans import learners, recipe
from terrasieve.sources import audit, readers, sinks


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 1, 0.1), ("c", 1, 0.9), ("c", 0, 0.1), ("c", 0, 0.9), ("d", 0, 0.2)], "g string, y int, p double"
    )
    m = {r["g"]: r for r in evaluate.classification_metrics(df, ["g"]).collect()}
    assert m["a"]["roc_auc"] == 0.5 and m["a"]["average_precision"] == 0.5
    assert m["b"]["roc_auc"] is None and m["b"]["average_precision"] is None and m["b"]["recall"] == 0.5
    assert m["c"]["roc_auc"] == 0.75 and m["d"]["recall"] == 0.0
    auc = {r["g"]: r["auc"] for r in stats.auc_by(df.withColumnRenamed("p", "value"), ["g"]).collect()}
    assert auc == {"a": 0.5, "b": None, "c": 0.75, "d": None}


def test_weighted_metrics_equal_repeated_rows(spark):
    base = spark.createDataFrame([(1, 1, 0.9, 2), (1, 0, 0.9, 1), (1, 0, 0.3, 3), (1, 1, 0.2, 1)], "g int, y int, p double, w int")
    again = base.select("g", "y", "p", F.explode(F.sequence(F.lit(1), F.col("w"))))
    a = evaluate.classification_metrics(base, ["g"], weight="w").first()
    b = evaluate.classification_metrics(again, ["g"]).first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_top_metrics_edges(spark):
    df = spark.createDataFrame([("n", i, 0, 1.0 - i / 100) for i in range(20)] + [("p", i, int(i < 5), 1.0 - i / 100) for i in range(20)], "g string, row_index long, y int, p double")
    t = {(r["g"], r["fraction"]): r for r in evaluate.top_metrics(df, ["g"]).collect()}
    assert t["n", 0.01]["k"] == 1 and t["n", 0.05]["lift"] is None and t["n", 0.05]["ndcg"] is None
    assert t["p", 0.10]["hits"] == 2 and t["p", 0.20]["recall"] == 0.8 and t["p", 0.20]["f1"] == pytest.approx(8 / 9)
    assert t["p", 0.05]["lift"] == pytest.approx(4.0)


def test_robust_z_branches(spark):
    rows = [(float(i), 5.0, 0.0, None) for i in range(7)] + [(1000.0, 5.0, 9.0, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, flat double, noiqr double, none double")
    z = stats.with_robust_z(df, ["a", "flat", "noiqr", "none"]).toPandas()
    assert z["a_z"].max() == 8.0 and set(z["flat_z"].dropna()) == {0.0} and z["none_z"].isna().all()
    x = pd.Series([0.0] * 7 + [9.0])
    assert z["noiqr_z"].dropna().tolist() == pytest.approx(((x - x.mean()) / x.std()).tolist())


def test_spearman_ranks_each_pair_anew(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.integers(0, 9, size=(200, 3)).astype(float), columns=["t", "c", "k"])
    pdf.loc[rng.random(200) < 0.3, "t"] = np.nan
    pdf.loc[rng.random(200) < 0.3, "c"] = np.nan
    pdf["k"] = 1.0
    df = readers.nan_to_null(spark.createDataFrame(pdf))
    got = {r["covariate"]: r for r in stats.spearman_pairs(df, ["t"], ["c", "k"]).collect()}
    both = pdf[["t", "c"]].dropna()
    assert got["c"]["n_pairs"] == len(both) and got["c"]["spearman"] == pytest.approx(both["t"].rank().corr(both["c"].rank()))
    assert got["k"]["spearman"] is None
    few = {r["covariate"]: r["spearman"] for r in stats.spearman_pairs(df.limit(20), ["t"], ["c"]).collect()}
    assert few == {"c": None}
    screen = {r["target_column"]: r for r in stats.spearman_screen(stats.spearman_pairs(df, ["t"], ["k", "c"])).collect()}
    assert screen["t"]["best_climate_column"] == "c"


def test_residualizer_is_the_closed_form(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=80), "w": rng.normal(size=80), "const": 3.0, "y": rng.normal(size=80)})
    pdf.loc[::9, "y"], pdf.loc[::7, "x"] = np.nan, np.nan
    df = readers.nan_to_null(spark.createDataFrame(pdf))
    fitted = stats.Residualizer(["y"], ["x", "w", "const"]).fit(df)
    got = fitted.transform(df).toPandas()["y_climate_resid"].to_numpy()
    f = pdf.fillna(pdf.median())
    c = f[["x", "w", "const"]].to_numpy()
    sd = c.std(0)
    z = (c - c.mean(0)) / np.where(sd > 0, sd, 1)
    y = f["y"].to_numpy()
    beta = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert got == pytest.approx(y - y.mean() - z @ beta)


def test_partial_correlation_and_p(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"a": x + rng.normal(size=300), "b": x + rng.normal(size=300), "c": x})
    g = stats.gram(spark.createDataFrame(pdf), [F.col(c) for c in "abc"], list("abc"))
    r, p = stats.ridge_partial_corr(g, "a", "b")
    assert abs(r) < 0.2 and p > 0.001
    assert stats.student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.student_t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_cohen_d_guards(spark):
    df = spark.createDataFrame([("e", 1, 1.0), ("e", 0, 2.0), ("f", 1, 1.0), ("f", 1, 1.0), ("f", 0, 1.0), ("f", 0, 1.0)], "env string, y int, v double")
    out = {r["env"]: r for r in stats.feature_effects(df, "env", "y", ["v"]).collect()}
    assert out["e"]["cohen_d"] is None and out["f"]["cohen_d"] == 0.0 and out["f"]["auc"] == 0.5


def test_climate_score_is_standardised_and_gamma_zero_changes_nothing(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(100, 2)), columns=["a", "b"]))
    s = stats.ClimateScore(["a", "b"]).fit(df)
    m = df.select(s.score().alias("s")).agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    assert m["m"] == pytest.approx(0, abs=1e-12) and m["d"] == pytest.approx(1)
    same = df.withColumn("z", stats.contaminated("a", F.lit(1.0), s.score(), 0.0)).where("abs(z - a) > 1e-12")
    assert same.isEmpty()


def test_lightest_fold_of_the_eleven_states():
    sizes = dict(AZ=638, WA=407, NV=308, CA=77, ID=55, MT=55, OR=44, UT=44, WY=33, CO=55, NM=22)
    folds = splits.lightest_fold(list(sizes.items()), 5)
    load = [sum(n for s, n in sizes.items() if folds[s] == f) for f in range(5)]
    assert sorted(load, reverse=True) == [638, 407, 308, 198, 187]


def test_folds_cover_rows_once_and_do_not_split_groups(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("string").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    f = splits.group_kfold(df, "g", 3)
    assert f.count() == 60 and f.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    tt = splits.train_test(f, [0, 1, 2])
    assert tt.count() == 180 and tt.where("is_test").count() == 60
    s = splits.stratified_kfold(df, "y", ["id"], 4).groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in s.collect())
    assert splits.usable_splits(df, "y") == 5
    with pytest.raises(guards.ContractError):
        splits.usable_splits(df.withColumn("y", F.lit(0)), "y")


def test_matched_columns_keep_the_quartile(spark):
    cat = spark.createDataFrame([(f"c{i}", i / 20) for i in range(20)], "column string, missing_rate double")
    got = splits.matched_columns(cat, ["c0", "c1", "c19"], F.xxhash64("column"), others_only=True).collect()
    assert len(got) == 3 and len({r["column"] for r in got}) == 3 and not {r["column"] for r in got} & {"c0", "c1", "c19"}
    every = splits.matched_columns(cat, [f"c{i}" for i in range(5)], F.xxhash64("column")).collect()
    assert {r["column"] for r in every} == {f"c{i}" for i in range(5)}


def test_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert guards.contract_join(a, b, ["k"], complete=True).count() == 3
    for left, right, kind in ((b, a, "many_to_one"), (a, b, "one_to_one")):
        with pytest.raises(guards.ContractError):
            guards.contract_join(left, right, ["k"], contract=kind)
    with pytest.raises(guards.ContractError):
        guards.contract_join(a.withColumn("k", F.lit(9)), b, ["k"], complete=True)
    guards.expect_same_rows(a, a)
    with pytest.raises(guards.ContractError):
        guards.expect_same_rows(a, a.limit(1))
    assert guards.union_all([a, b]).columns == ["k", "v", "w"]


def test_unpaired_fold_raises(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "c", 0.5 + 1e-13), (2, "b", 0.4)], "fold int, model string, auc double")
    ok = evaluate.paired_contrast(df.where("fold = 1"), ["fold"], "model", "b", "c", ["auc"]).first()
    assert (ok["better"], ok["equal"], ok["worse"]) == (0, 1, 0)
    with pytest.raises(Exception, match="lacks its pair"):
        evaluate.paired_contrast(df, ["fold"], "model", "b", "c", ["auc"]).collect()


def test_rules_first_match_and_unknown_kind(spark):
    f = spark.createDataFrame([("climate_ppt_pet",), ("climate_ppt_x",), ("other",)], "feature_name string")
    rules = [("exact", "climate_ppt_pet", "ratio"), ("prefix", "climate_ppt_", "rain")]
    out = {r["feature_name"]: r["concept"] for r in catalog.resolve_first_match(f, catalog.rules_frame(spark, rules, "match_type string, pattern string, concept string")).collect()}
    assert out == {"climate_ppt_pet": "ratio", "climate_ppt_x": "rain", "other": None}
    bad = catalog.rules_frame(spark, [("regex", "a", "b")], "match_type string, pattern string, concept string")
    with pytest.raises(Exception, match="unknown match kind"):
        catalog.resolve_first_match(f, bad).collect()


def test_roles_and_feature_sets(spark):
    df = spark.createDataFrame([(1, "s", 1.0, 2.0, 3.0, None, "g")], "Y_label int, sample_id string, geochem1_cu double, climate_ppt_annual_sum double, gravity_x double, env_aridity_index double, env_causal_group string")
    cat = settled(catalog.role_catalog(df))
    role = {r["column"]: r["role"] for r in cat.collect()}
    assert role == {"Y_label": "target", "sample_id": "metadata", "geochem1_cu": "geochemistry", "climate_ppt_annual_sum": "climate", "gravity_x": "geo_structure", "env_aridity_index": "climate", "env_causal_group": "environment_group"}
    sets = catalog.feature_sets(cat)
    assert sets["no_climate"] == ["geochem1_cu", "gravity_x"] and sets["climate_adjusters"] == ["climate_ppt_annual_sum", "env_aridity_index"]


def test_recipes(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"g": c + 0.1 * rng.normal(size=200), "h": rng.normal(size=200), "s": rng.normal(size=200), "c": c, "y": (rng.random(200) < 0.4).astype(int)}))
    sets = {"full": ["g", "h", "s", "c"], "no_climate": ["g", "h", "s"], "core_geo": ["g", "h", "s"], "climate_adjusters": ["c"], "geochemistry": ["g", "h"]}
    r = recipe.make_recipe("M4_Spearman", df, sets).fit(df)
    assert r.residual == ["g"] and r.output_columns == ["g_climate_resid", "h", "s"]
    assert recipe.make_recipe("M3_Broad", df, sets).fit(df).output_columns == ["g_climate_resid", "h_climate_resid", "s"]
    assert recipe.make_recipe("NoClimate", df, sets).fit(df).output_columns == ["g", "h", "s"]
    assert recipe.make_recipe("M4_GraphUnion", df, sets, graph=["s"]).fit(df).residual == ["g", "s"]
    with pytest.raises(ValueError):
        recipe.make_recipe("nothing", df, sets)
    model = learners.fit(r.transform(df), r.output_columns, "y", "logistic_l1")
    p = learners.score(model, r.transform(df), r.output_columns, ["y"]).toPandas()["p"]
    assert p.between(0, 1).all()
    with pytest.raises(guards.ContractError):
        learners.fit(df.where("y = 1"), ["g"], "y")


def test_within_and_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(120), "lat": rng.uniform(-85, 85, 120), "lon": np.where(rng.random(120) < 0.3, 179.9, rng.uniform(-180, 180, 120))})
    pdf.loc[100:, ["lat", "lon"]] = pdf.loc[:19, ["lat", "lon"]].to_numpy() + [[0.3, 0.2]]
    pdf["lon"] = (pdf["lon"] + 180) % 360 - 180
    df = spark.createDataFrame(pdf)

    def km(a, b):
        p, q = math.radians(a.lat), math.radians(b.lat)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        return 2 * S.EARTH_RADIUS_KM * math.asin(math.sqrt(min(1, h)))

    pts = list(pdf.itertuples())
    want = {(a.id, b.id) for a in pts for b in pts if km(a, b) <= 400}
    got = [(r["id"], r["r_id"]) for r in spatial.within(df, df, 400.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = df.where("id < 30"), df.where("id >= 30")
    near = {r["id"]: r["r_id"] for r in spatial.nearest(left, right, "id", "id").collect()}
    assert near == {a.id: min((km(a, b), b.id) for b in pts if b.id >= 30)[1] for a in pts if a.id < 30}
    assert spatial.remove_buffer(left, right, "id", 0.0).count() == 30


def test_clusters_of_a_chain(spark):
    df = spark.createDataFrame([(i, 40.0, -110 + i * 0.01) for i in range(12)] + [(50, 10.0, 0.0)], "id long, lat double, lon double")
    out = {r["id"]: r["cluster"] for r in spatial.eps_components(df, "id", 1.0).collect()}
    assert out == {**{i: 0 for i in range(12)}, 50: 50}


def test_graph_fusion_min_max_edges(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, v double")
    scaled = lambda d: [r["s"] for r in stats.min_max_scaled(d, {"s": "v"}).collect()]
    assert scaled(df) == [0.0, 0.0]
    assert scaled(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")) == [1.0, 1.0, 1.0]
    assert scaled(spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double").coalesce(1)) == [0.0, None, 1.0]
    e = spark.createDataFrame([("y", "g", "target", "geochemistry"), ("g", "c", "geochemistry", "climate"), ("g", "h", "geochemistry", "geochemistry")], "a string, b string, group_a string, group_b string")
    got = {(r["source"], r["target"]): r["directed"] for r in graph.orient(e).collect()}
    assert got == {("g", "y"): True, ("c", "g"): True, ("g", "h"): False}


def test_audit_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine\n/home/someone/x\n")
    files = audit.file_info(spark, str(tmp_path), "*.txt")
    assert files.count() == 1 and audit.oversized(files, 3).count() == 1
    assert [r["pattern"] for r in audit.lines_matching(spark, str(tmp_path), ["/home/", "/Users/"], "*.txt").collect()] == ["/home/"]
    have = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    want = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "name string, sha256 string")
    assert {(r["name"], r["problem"]) for r in audit.checksum_differences(have, want).collect()} == {("b", "changed"), ("c", "missing")}


def test_readers_and_sinks(spark, tmp_path):
    bom = tmp_path / "bom.csv"
    bom.write_bytes("﻿name;v\nä|x;1\nb;NaN\n".encode())
    assert readers.sniff_csv(spark, str(bom)) == {"encoding": "utf-8", "delimiter": ";"}
    assert readers.read_sniffed_csv(spark, str(bom)).columns == ["name", "v"]
    (tmp_path / "gb.csv").write_bytes("名,v\n值,1\n".encode("gb18030"))
    assert readers.sniff_csv(spark, str(tmp_path / "gb.csv"))["encoding"] == "gb18030"
    assert [tuple(r) for r in readers.read_sniffed_csv(spark, str(tmp_path / "gb.csv")).collect()] == [("值", "1")]
    assert readers.count_csv_rows(spark, str(bom)) == 3
    grid = tmp_path / "grid.txt"
    grid.write_text("1700 1.5 -99.999\n\n1701  2.5 3\n")
    rows = {(r["year"], r["cell"]): r["value"] for r in readers.read_fixed_grid(spark, str(grid)).collect()}
    assert rows == {(1700, 0): 1.5, (1700, 1): None, (1701, 0): 2.5, (1701, 1): 3.0}
    (tmp_path / "t.tsv").write_text("# note\nyear\ta\t\n1\t2\t3\n")
    assert readers.read_commented_tsv(spark, str(tmp_path / "t.tsv")).columns == ["year", "a"]
    df = spark.createDataFrame([("a|b", 1.23456, None), ("c", float("nan"), 2)], "n string, x double, k int")
    assert sinks.markdown_table(df).splitlines()[2] == "| a\\|b | 1.2346 |  |"
    sinks.write_table(df, str(tmp_path / "o.parquet"))
    back = readers.read_table(spark, str(tmp_path / "o.parquet"), columns=["x"])
    assert back.where("x is null").count() == 1
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_manifest(spark, {"a": 1}, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        sinks.write_manifest(spark, {"a": float("nan")}, str(tmp_path / "m2.json"))
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "d.csv").write_text("a\n1\n")
    assert readers.discover_dataset(spark, str(tmp_path / "run")).endswith("d.csv")
    (tmp_path / "run" / "run_manifest.json").write_text(json.dumps({"input_path": str(bom)}))
    assert readers.discover_dataset(spark, str(tmp_path / "run")) == str(bom)
    assert readers.flatten_paths({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}
    e = spark.createDataFrame([("a b", "c", 0.5)], "source string, target string, edge_weight double")
    assert sinks.mermaid_flowchart(e).splitlines()[1].strip() == 'a_b["a b"] -->|0.500| c["c"]'


def test_small_files_and_refusals(spark, tmp_path):
    df = spark.range(201).toDF("n")
    for write in (lambda: sinks.markdown_table(df), lambda: sinks.write_small_csv(df, str(tmp_path / "c.csv"), most_rows=200)):
        with pytest.raises(ValueError):
            write()
    sinks.write_small_csv(df, str(tmp_path / "c.csv"))
    assert (tmp_path / "c.csv").read_bytes()[:3] == b"\xef\xbb\xbf" and readers.read_table(spark, str(tmp_path / "c.csv")).agg(F.sum("n")).first()[0] == 20100
    for n in (5, 20):
        df.write.parquet(str(tmp_path / f"runs/ratio_1_{n}/d.parquet"))
    found = readers.ratio_datasets(spark, str(tmp_path / "runs"), [5, 20])
    assert spark.read.parquet(found[20]).count() == 201 and spark.createDataFrame([(found[5],)], "p string").select(readers.ratio_label(F.col("p"))).first()[0] == "1:5"
    with pytest.raises(FileNotFoundError):
        readers.ratio_datasets(spark, str(tmp_path / "runs"), [7])
    with pytest.raises(FileNotFoundError):
        readers.discover_dataset(spark, str(tmp_path / "nothing"))
    (tmp_path / "c.json").write_text('{"a": {"b": 2}}')
    assert readers.flatten_paths(readers.load_config(spark, str(tmp_path / "c.json"))) == {"a.b": 2}
    assert readers.read_csv_rows(spark, str(tmp_path / "c.csv"), most=2) == [{"n": "0"}, {"n": "1"}]


def test_scenarios_of_a_perturbation(spark):
    from terrasieve.operators import evaluate

    df = spark.createDataFrame([(20.0, 50.0)], "a_TMEAN double, rain double")
    got = {s: df.select(*[c.alias(k) for k, c in evaluate.perturbed(df.columns, s, {"a_TMEAN": 1.0, "rain": 2.0}).items()]).first()[:] for s in ("original", "plus", "minus", "train_median")}
    assert got == {"original": (20.0, 50.0), "plus": (21.0, pytest.approx(55.0)), "minus": (19.0, 45.0), "train_median": (1.0, 2.0)}
    with pytest.raises(ValueError):
        evaluate.perturbed(["rain"], "climate_plus")


def test_consensus_signs(spark):
    from terrasieve.operators import graph

    rows = [("0", 0.0), ("1", None)]
    e = spark.createDataFrame([(env, "a", "b", "geochemistry", "target", True, 0.1, pc, False, 1) for env, pc in rows], "environment string, source string, target string, source_group string, target_group string, directed boolean, edge_weight double, partial_corr double, selected_by_target_logistic boolean, rank_in_environment int")
    got = graph.edge_consensus(e, 2).first()
    assert got["partial_corr_sign"] == "zero_or_unknown" and not got["sign_consistent"]
    assert graph.knowledge_triples(graph.edge_consensus(e, 2), 2).first()["confidence"] == "medium"


def test_running_sums_of_one_group_over_many_ranges(spark):
    from terrasieve.operators import ranges

    df = spark.range(0, 3000, 1, 5).select((F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 3).alias("w"))
    got = ranges.running_sums(df, [], [F.desc("v")], {"before": "w"}, rows_per_range=100).toPandas().sort_values("v", ascending=False)
    assert got["before"].tolist() == (got["w"].cumsum() - got["w"]).tolist()
    x = df.select(F.lit("g").alias("g"), F.sqrt("v").alias("v"))
    q = ranges.quantiles(x, ["g"], "v", (0.0, 0.25, 0.5, 0.95, 1.0), rows_per_range=100).first()
    assert q["q"] == pytest.approx(np.quantile(x.toPandas()["v"], [0, 0.25, 0.5, 0.95, 1]).tolist(), rel=1e-12) and q["n"] == 3000


def test_components_of_a_long_chain(spark):
    from terrasieve.operators.components import connected

    for n, options in ((5000, {}), (300, {"one_task": 0})):
        names = np.random.default_rng(2).permutation(n).tolist()
        edges = spark.createDataFrame(list(zip(names, names[1:])) + [(7000, 7000), (0, 0), (8001, 8000), (None, 1)], "a long, b long")
        rows = connected(edges, **options).collect()
        got = {r["node"]: r["component"] for r in rows}
        assert len(rows) == len(got) and got == {**dict.fromkeys(names, 0), 7000: 7000, 8000: 8000, 8001: 8000}
    assert connected(edges.where("false")).count() == connected(edges.where("false"), one_task=-1).count() == 0


def test_clusters_of_dense_places_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    lat = np.concatenate([rng.uniform(10, 10.2, 300), rng.normal(-80, 0.3, 100), rng.uniform(-0.1, 0.1, 100)])
    lon = np.concatenate([rng.uniform(20, 20.2, 300), rng.uniform(-180, 180, 100), np.where(rng.random(100) < 0.5, 179.9, -179.9)])
    for km in (2.0, 30.0):
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "id long, lat double, lon double")
        got = {r["id"]: r["cluster"] for r in spatial.eps_components(df, "id", km).collect()}
        p, q = np.radians(lat), np.radians(lon)
        h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
        near, label = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(h, 1))) <= km, np.arange(500)
        while True:
            new = np.where(near, label[None], 500).min(axis=1)
            if (new == label).all():
                break
            label = new
        assert got == dict(enumerate(label.tolist()))


def test_many_columns_are_residualised(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 400)).cumsum(axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(400)])
    fitted = stats.Residualizer([f"c{i}" for i in range(20, 400)], [f"c{i}" for i in range(20)]).fit(df)
    got = fitted.transform(df).select("c399_climate_resid", "c20_climate_resid").toPandas().to_numpy()
    z = (x[:, :20] - x[:, :20].mean(0)) / x[:, :20].std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(20), z.T @ (x[:, [399, 20]] - x[:, [399, 20]].mean(0)))
    want = x[:, [399, 20]] - x[:, [399, 20]].mean(0) - z @ w
    assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0), atol=1e-6)


def test_grams_by_group_agree_in_both_forms(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, float(i % 5), float(i * i % 11), 1e9 + i) for i in range(200)], "g int, a double, b double, c double")
    one = stats.gram_by(df, ["g"], [F.col(c) for c in "abc"], list("abc"))
    monkeypatch.setattr(stats, "MOST_PRODUCTS", 0)
    two = stats.gram_by(df, ["g"], [F.col(c) for c in "abc"], list("abc"))
    assert set(one) == set(two) == {(0,), (1,), (2,), (None,)}
    for k in one:
        assert np.allclose(one[k].cov, two[k].cov, rtol=1e-9) and one[k].n == two[k].n


def test_series(spark):
    v = spark.createDataFrame([(0, 1700, 1.0), (0, 1701, None), (0, 1800, 3.0)], "cell int, year int, value double")
    out = {(r["first_year"], r["last_year"]): r for r in series.period_summary(v, [(1700, 1750), (1700, 1850), (1900, 1950)]).collect()}
    assert len(out) == 2 and out[1700, 1750]["valid_fraction"] == 0.5 and out[1700, 1850]["mean"] == 2.0 and out[1700, 1850]["std"] == 1.0
    assert series.quality_summary(v, {"v": ("VALUE",)}).first()["v_valid"] == 2


def test_scalars(spark):
    df = spark.createDataFrame([("concept_x", float("nan"), "1e3", 2.5), ("y", 1.0, "n/a", -0.5)], "s string, v double, t string, h double")
    r = df.select(S.strip_prefix(F.col("s"), "concept_").alias("a"), S.missing_as_null(F.col("v")).alias("b"), S.to_number(F.col("t")).alias("c"), S.round_half_even(F.col("h"), 0).alias("d")).collect()
    assert [x["a"] for x in r] == ["x", "y"] and [x["b"] for x in r] == [None, 1.0] and [x["c"] for x in r] == [1000.0, None] and [x["d"] for x in r] == [2.0, 0.0]
    m = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double").select(S.row_median([F.col(c) for c in "abc"]).alias("m")).collect()
    assert [x["m"] for x in m] == [2.0, None]
    assert spark.range(1).select(S.pair_key(F.lit("b"), F.lit("a"), F.lit(False)), S.padded("top", F.lit(5))).first()[:] == ("a -- b", "top05")


def test_selection_and_poisson_weights(spark):
    w = spark.range(20_000).select(stats.poisson_weight(F.lit(3), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert w["m"] == pytest.approx(1, abs=0.05) and w["v"] == pytest.approx(1, abs=0.1)
    df = spark.range(400).select("id", F.lit("e").alias("env"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("good"), F.rand(2).alias("bad"))
    out = {r["concept"]: r["selection_rate"] for r in stats.selection_rates(df, "env", "y", ["bad", "good"], lambda i: stats.poisson_weight(i, F.col("id")), iterations=10, top_k=1).collect()}
    assert out == {"good": 1.0, "bad": 0.0}
    few = stats.selection_rates(df.limit(8), "env", "y", ["bad", "good"], lambda i: F.lit(1), iterations=2)
    assert few.count() == 0


def test_align_and_published_metric(spark):
    left = spark.createDataFrame([("a", 0), ("b", 1)], "k string, row_index int")
    right = spark.createDataFrame([("b", 0, 20), ("a", 1, 10)], "k string, row_index int, v int")
    assert {r["k"]: r["v"] for r in guards.align(left, right, "k").collect()} == {"a": 10, "b": 20}
    twice = right.withColumn("k", F.lit("a"))
    assert {r["k"]: r["v"] for r in guards.align(left, twice, "k").collect()} == {"a": 20, "b": 10}
    m = spark.createDataFrame([("M2", 0.5), ("M2", 0.7)], "model string, ap double")
    guards.expect_metric(m, "M2", "ap", 0.6)
    with pytest.raises(guards.ContractError):
        guards.expect_metric(m, "M2", "ap", 0.61)


def test_nearest_rows_are_exact_in_dense_and_sparse_places(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(0, 1e-4, (150, 3)), [[500.0, -40.0, 7.0]]])
    x[:, 2] = np.round(x[:, 2])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    scale = [2.0, 0.5, 3.0]
    d = np.sqrt((((x[:, None] - x[None]) / scale) ** 2).sum(-1))
    got = {}
    for r in neighbours.k_nearest(df, "id", "v", 4, scale).orderBy("id", "nth").collect():
        got.setdefault(r["id"], []).append(r["distance"])
    assert len(got) == len(x)
    for i, found in got.items():
        assert found == pytest.approx(np.sort(np.delete(d[i], i))[:4].tolist(), rel=1e-9)


def test_nearest_rows_of_few(spark):
    one = spark.createDataFrame([(1, [0.0])], "id long, v array<double>")
    assert neighbours.k_nearest(one, "id", "v").count() == neighbours.k_nearest(one.where("false"), "id", "v").count() == 0
    two = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, v array<double>")
    assert sorted(tuple(r)[:3] for r in neighbours.k_nearest(two, "id", "v").collect()) == [(1, 1, 2), (2, 1, 1)]


def test_interpolation_balances_within_the_class(spark):
    rows = [(i, 0, float(i % 7), 1.0) for i in range(50)] + [(100 + i, 1, float(i), float(i * i)) for i in range(9)] + [(200 + i, 1, 2.0, 4.0) for i in range(9)] + [(300, 1, None, 1.0), (301, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = learners.smote_like(df, ["a", "b"], "y", "id").collect()
    new = [r for r in out if r["id"] is None]
    assert len(out) - len(new) == len(rows) and len(new) == 50 - 19 and all(r["y"] == 1 for r in new)
    assert all(0 <= r["a"] <= 8 and r["a"] ** 2 - 1e-9 <= r["b"] <= 64 for r in new)  # chords of a parabola lie above it
    alone = spark.createDataFrame([(1, 1, 2.0), (2, 0, 1.0), (3, 0, 1.5), (4, 0, 0.5)], "id long, y int, a double")
    assert sorted(r["a"] for r in learners.smote_like(alone, ["a"], "y", "id").where("id is null").collect()) == [2.0, 2.0]
    assert learners.smote_like(df.where("false"), ["a", "b"], "y", "id").count() == 0


def test_numbers_within_groups_over_many_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold").alias("g"), F.repeat(F.lit("x"), 30).alias("pad"))
    got = guards.number_within(df, ["g"], [F.col("id") * 7919 % 10007, "id"], rows_per_range=300).toPandas()
    assert len(got) == 5000 and list(got.columns) == ["id", "g", "pad", "row_index"]
    for _, part in got.groupby("g", dropna=False):
        part = part.assign(o=part["id"] * 7919 % 10007).sort_values(["o", "id"])
        assert part["row_index"].tolist() == list(range(len(part)))


def test_baselines_and_penalties(spark):
    from terrasieve.plans import experiments

    df = spark.range(600).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"), (F.rand(1) + (F.col("id") % 4 == 0).cast("double")).alias("good"), F.rand(2).alias("bad"))
    out = {(r["model"], r["fold"]): r for r in experiments.baselines(settled(df), ["good", "bad"], "y", "id", ("dummy", "logistic_l2")).collect()}
    assert len(out) == 6 and all(out["logistic_l2", f]["roc_auc"] > 0.8 for f in range(3))
    assert all(out["dummy", f]["n_pos"] == 50 and abs(out["dummy", f]["roc_auc"] - 0.5) < 0.15 for f in range(3))
    dummy = learners.dummy_scores(df, 0.25, ["id"], "id").agg(F.avg("p")).first()[0]
    assert dummy == pytest.approx(0.25, abs=0.06)
    assert learners.estimator("logistic_l1", 0, rows=100).getRegParam() == pytest.approx(1 / 25) and learners.estimator("logistic_l2", 0, rows=100).getRegParam() == pytest.approx(1 / 100)
    with pytest.raises(ValueError):
        learners.estimator("perceptron", 0)
    forest = learners.fit(df, ["good", "bad"], "y", "forest", trees=5)
    assert [f for f, _ in learners.importances(forest, ["bad", "good"][::-1])][0] == "good"
    sparse = learners.fit(df, ["good", "bad"], "y", "logistic_l1")
    assert "good" in learners.l1_selected(sparse, ["good", "bad"])


def test_split_guards(spark):
    one = spark.createDataFrame([(1, 1), (2, 0)], "id int, y int")
    with pytest.raises(guards.ContractError):
        splits.usable_splits(one, "y")
    with pytest.raises(guards.ContractError):
        splits.frozen_folds(one, spark.createDataFrame([(1, 0)], "id int, fold int"), ["id"])
    with pytest.raises(guards.ContractError):
        guards.expect_no_missing(spark.createDataFrame([(None,)], "v int"), ["v"])
    with pytest.raises(guards.ContractError):
        guards.expect_subset(one, one.where("id = 1"), ["id"])
    drawn = splits.draws(one, "id", 50, 3).groupBy("iteration").agg(F.sum("times").alias("n")).collect()
    assert len(drawn) == 50 and all(r["n"] == 2 for r in drawn)


def test_linear_folds_against_numpy(spark):
    from terrasieve.plans import linear

    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) + 5
    y = (x[:, 0] - x[:, 3] + rng.normal(size=120) > 0).astype(int)
    x[::9, 1] = np.nan
    rows = [(i, i % 3, int(y[i]), *[None if v != v else float(v) for v in x[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double, d double")
    models = linear.fit_folds(df, list("abcd"), "y")
    for f in models.grams:
        models.add("m", f, ["a"], ["b"], ["c", "d"])
    got = {r["id"]: r["p"] for r in models.score(df, ["id", "fold"]).collect()}
    for f in range(3):
        train, test = np.arange(120) % 3 != f, np.arange(120) % 3 == f
        fill = np.nanmedian(x[train], axis=0)
        z = np.where(np.isnan(x), fill, x)
        c = (z[:, 2:] - z[train][:, 2:].mean(0)) / z[train][:, 2:].std(0)
        w = np.linalg.solve(c[train].T @ c[train] + 10 * np.eye(2), c[train].T @ (z[train, 1] - z[train, 1].mean()))
        features = np.stack([z[:, 0], z[:, 1] - z[train, 1].mean() - c @ w], axis=1)
        s = (features - features[train].mean(0)) / features[train].std(0)
        v = np.linalg.solve(s[train].T @ s[train] + 10 * np.eye(2), s[train].T @ (y[train] - y[train].mean()))
        assert [got[i] for i in np.flatnonzero(test)] == pytest.approx((y[train].mean() + s[test] @ v).tolist(), abs=1e-9)


def test_rank_correlations_of_wide_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(np.round(rng.normal(size=(150, 6)), 1), columns=list("abcdef"))
    pdf["b"] = pdf["a"] + pdf["b"]
    pdf.loc[::5, ["a", "c"]] = np.nan
    pdf.loc[::7, "d"] = np.nan
    pdf["e"] = 1.0
    pdf["g"] = np.where(np.arange(150) % 3 == 0, None, np.arange(150) % 2)
    df = spark.createDataFrame([[None if v != v else v for v in r] for r in pdf.astype(object).itertuples(index=False)], "a double, b double, c double, d double, e double, f double, g int")
    args = (df, ["a", "b", "d"], ["c", "e", "f"])
    monkeypatch.setattr(stats, "MOST_PAIRS", 0)
    monkeypatch.setattr(stats, "MOST_PRODUCTS", 3)
    for by, keys in (([], [()]), (["g"], [(0,), (1,), (None,)])):
        got = {tuple(r[c] for c in (*by, "target", "covariate")): r for r in stats.spearman_pairs(*args, min_pairs=10, by=by).collect()}
        assert len(got) == 9 * len(keys)
        for key in keys:
            part = pdf if not key else pdf[pdf["g"].isna()] if key[0] is None else pdf[pdf["g"] == key[0]]
            for t in "abd":
                for c in "cef":
                    both = part[[t, c]].dropna()
                    r = got[(*key, t, c)]
                    assert r["n_pairs"] == len(both)
                    assert r["spearman"] is None if c == "e" else r["spearman"] == pytest.approx(both[t].rank().corr(both[c].rank()), abs=1e-12)
