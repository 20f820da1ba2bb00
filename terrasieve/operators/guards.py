"""Contracts on tables: keys, matches, coverage, and stable row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


class ContractError(ValueError):
    """A table does not hold what an operator needs."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"{list(keys)} is not unique")
    return df


def expect_all_matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not left.join(right, list(keys), "left_anti").isEmpty():
        raise ContractError(f"rows without a partner by {list(keys)}")
    return left


def expect_same_rows(a: DataFrame, b: DataFrame) -> None:
    """Equal as multisets, as in a replay of frozen folds."""
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ContractError("the tables differ")


def contract_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", contract: str = "many_to_one", complete: bool = False) -> DataFrame:
    """A join whose right keys (and left ones, if one_to_one) must be unique,
    and, if ``complete``, whose left rows must all find a partner."""
    expect_unique(right, keys)
    if contract == "one_to_one":
        expect_unique(left, keys)
    if complete:
        expect_all_matched(left, right, keys)
    return left.join(right, list(keys), how)


def match_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by side of a full join: both, left_only, right_only."""
    l, r = left.select(*keys).withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return l.join(r, list(keys), "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "row_index", rows_per_range: int = ranges.ROWS_PER_RANGE) -> DataFrame:
    """Positions from 0 within each group of ``by`` (nulls are one group) in
    the order of ``order`` (a total order); no task sorts a whole group."""
    return ranges.running_sums(df, by, order, {name: F.lit(1).cast("long")}, rows_per_range)


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_index", rows_per_range: int = ranges.ROWS_PER_RANGE) -> DataFrame:
    """Positions from 0 in the order of ``order`` (a key) over all rows."""
    return number_within(df, [], order, name, rows_per_range)


def expect_no_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row must hold a value in each of the columns."""
    missing = [c for c, n in df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict().items() if n]
    if missing:
        raise ContractError(f"missing values in {missing}")
    return df


def expect_subset(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of ``left`` must be one of ``right``."""
    return expect_all_matched(left.select(*keys).distinct(), right.select(*keys), keys)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def align(left: DataFrame, right: DataFrame, key: str, position: str = "row_index") -> DataFrame:
    """Right rows for left ones: by ``key`` where both sides hold it once and
    the left is covered, else by ``position``, which must then cover it."""
    by_key = duplicate_keys(left, [key]).isEmpty() and duplicate_keys(right, [key]).isEmpty() and left.join(right, key, "left_anti").isEmpty()
    return contract_join(left, right.drop(position), [key]) if by_key else contract_join(left, right.drop(key), [position], contract="one_to_one", complete=True)


def expect_metric(metrics: DataFrame, model: str, column: str, expected: float, tolerance: float = 1e-10) -> None:
    """The mean over folds of a model's metric must be what was published."""
    got = metrics.where(F.col("model") == model).agg(F.avg(column).alias("m")).first()["m"]
    if got is None or abs(got - expected) > tolerance:
        raise ContractError(f"{model} {column}: {got} is not {expected}")
