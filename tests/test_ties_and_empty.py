"""Ties of rank screens, and folds of which a buffer leaves nothing."""

from __future__ import annotations

from terrasieve import queries as q
from terrasieve.operators import stats


def test_last_digits_do_not_break_a_tie(spark):
    """Equal columns may get correlations that differ by rounding alone."""
    rows = [("t", "zz", 0.001405021, 50), ("t", "aa", 0.001405021 + 2e-16, 50)]
    pairs = spark.createDataFrame(rows, "target string, covariate string, spearman double, n_pairs long")
    assert stats.spearman_screen(pairs, covariates=["zz", "aa"]).first()["best_climate_column"] == "zz"


def test_a_fold_without_training_rows_is_kept(spark, tmp_path):
    """41,400 customer keys on, a place is met again: all rows are taken."""
    rows = [(k + 41_400 * i, f"c{k}", i, 1.0, "A") for k in range(5) for i in range(2)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["state"]: (r["own"], r["n_train"]) for r in q.buffer_removal(spark, str(tmp_path)).collect()}
    assert got == {0: (5, 0), 1: (5, 0)}
