"""Writers: tables, JSON manifests and lines, Markdown tables, flowcharts."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV (with a header) by suffix, as a folder of part files."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_small_csv(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """One CSV file with a byte order mark, for reports of bounded size."""
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; use write_table")
    files.write_text(df.sparkSession, str(path), "\ufeff" + rows.to_csv(index=False))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_manifest(spark: SparkSession, manifest: dict[str, Any], path: str) -> None:
    """Strict JSON: NaN and infinities are refused."""
    files.write_text(spark, str(path), json.dumps(manifest, indent=2, ensure_ascii=False, allow_nan=False) + "\n")


def markdown_table(df: DataFrame, most_rows: int = 200, digits: int = 4) -> str:
    """A Markdown table of a small result; pipes are escaped. One of more than
    ``most_rows`` rows raises."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; use write_table")

    def cell(v: Any) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return (f"{v:.{digits}f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def mermaid_flowchart(edges: DataFrame, source: str = "source", target: str = "target", weight: str = "edge_weight", most: int = 24) -> str:
    """A flowchart of the strongest edges, ties by names."""
    node = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]+", "_")
    top = edges.orderBy(F.desc(weight), source, target).limit(most)
    rows = top.select(node(F.col(source)).alias("a"), F.col(source).alias("an"), node(F.col(target)).alias("b"), F.col(target).alias("bn"), F.format_string("%.3f", F.col(weight).cast("double")).alias("w"))
    return "\n".join(["flowchart LR"] + [f'    {r["a"]}["{r["an"]}"] -->|{r["w"]}| {r["b"]}["{r["bn"]}"]' for r in rows.collect()])
