"""Gridded yearly series: windows of years, validity, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_summary(values: DataFrame, periods: Sequence[tuple[int, int]], by: Sequence[str] = ("cell",), year: str = "year", value: str = "value") -> DataFrame:
    """Valid share, mean and population deviation of each window of years
    (both ends inclusive). A row goes to every window that holds its year."""
    windows = F.array(*[F.struct(F.lit(a).alias("first_year"), F.lit(b).alias("last_year")) for a, b in periods])
    held = F.filter(windows, lambda w: (F.col(year) >= w["first_year"]) & (F.col(year) <= w["last_year"]))
    long = values.select(*by, F.col(value).cast("double").alias("v"), F.inline(held))
    return long.groupBy(*by, "first_year", "last_year").agg(
        F.count("*").alias("n_years"), F.count("v").alias("n_valid"), (F.count("v") / F.count("*")).alias("valid_fraction"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def column_ignoring_case(df: DataFrame, *names: str) -> Column:
    """The first of several names that the table has, in any case."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return F.col(f"`{have[n.lower()]}`")
    raise KeyError(f"none of {names}")


def quality_summary(df: DataFrame, fields: dict[str, tuple[str, ...]], minimum: float = 0.0) -> DataFrame:
    """Rows, valid values and those above ``minimum`` of each statistic."""
    aggs = [a for k, names in fields.items() for a in (F.count(column_ignoring_case(df, *names)).alias(f"{k}_valid"), F.count_if(column_ignoring_case(df, *names) > minimum).alias(f"{k}_positive"))]
    return df.agg(F.count("*").alias("n_rows"), *aggs)
