"""Audits: file metadata, checksums, and manifests against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_info(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and sha256 of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def checksum_differences(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Names whose sha256 differs, or that only one side has; both (name, sha256)."""
    e = expected.select("name", F.col("sha256").alias("expected"))
    m = measured.select("name", F.col("sha256").alias("measured"))
    both = e.join(m, "name", "full")
    return both.select(
        "name",
        F.when(F.col("measured").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("expected") != F.col("measured"), "changed").alias("problem"),
    ).where("problem is not null")


def table_shape(df: DataFrame, name: str, label: str | None = None) -> DataFrame:
    """One row: table, n_rows, n_columns, n_positive, n_negative."""
    y = F.col(label) if label else F.lit(None)
    return df.agg(
        F.lit(name).alias("table"),
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.count_if(y == 1).alias("n_positive"),
        F.count_if(y == 0).alias("n_negative"),
    )


def manifest_differences(measured: DataFrame, manifest: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long list of (keys, field, expected, measured) that disagree."""
    names = lambda df, side: df.select(*keys, *[F.col(v).cast("string").alias(f"{side}_{v}") for v in values], F.lit(True).alias(f"in_{side}"))
    both = names(manifest, "expected").join(names(measured, "measured"), keys, "full")
    fields = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"expected_{v}").alias("expected"), F.col(f"measured_{v}").alias("measured")) for v in values])
    return both.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.*").where(~F.col("expected").eqNullSafe(F.col("measured")))


def metadata_mismatches(left: DataFrame, right: DataFrame, keys: list[str], exact: list[str], near: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: how two tables of the same samples agree. Keys of either side
    alone, and for shared keys how many differ in each ``exact`` column (a
    null equals a null) and in each ``near`` one by more than ``tolerance``."""
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in (*exact, *near)], F.lit(True).alias(f"{p}here"))
    both = side(left, "_l_").join(side(right, "_r_"), keys, "full")
    shared = F.col("_l_here").isNotNull() & F.col("_r_here").isNotNull()
    apart = {c: ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in exact}
    for c in near:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        apart[c] = F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())
    return both.agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("_r_here").isNull()).alias("left_only"), F.count_if(F.col("_l_here").isNull()).alias("right_only"),
        *[F.count_if(shared & x).alias(f"differ_{c}") for c, x in apart.items()],
    )


def lines_matching(spark: SparkSession, path: str, patterns: list[str], glob: str = "*") -> DataFrame:
    """Lines of text files that match a forbidden pattern: path, pattern, line."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(p)) for p in patterns]))
    return lines.select("path", F.explode(hits).alias("pattern"), "line")


def oversized(files: DataFrame, most_bytes: int) -> DataFrame:
    return files.where(F.col("length") > most_bytes)
