"""Readers: tables by suffix, delimited text of unknown form, grids, discovery."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files

#: Encodings in the order in which they are tried, and delimiters.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "latin-1")
DELIMITERS = ",\t;|"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet or CSV table by its suffix; NaN of floating columns is null.

    ``columns`` prunes the read. Without ``schema`` a CSV's types are inferred.
    """
    if path.rstrip("/").endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("nanValue", "NaN")
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if columns is not None:
        df = df.select(*columns)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) for c in floats})


def sniff_csv(spark: SparkSession, path: str, sample_bytes: int = 65_536) -> dict[str, str]:
    """Encoding and delimiter of a CSV from the bytes at its head; only those
    are read, from any store."""
    data = files.head(spark, path, sample_bytes)
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError as e:
            if e.start >= len(data) - 4 and len(data) >= sample_bytes:  # a character cut by the sample's end
                text = data[: e.start].decode(encoding)
                break
    try:
        delimiter = csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter
    except csv.Error:
        delimiter = ","
    return {"encoding": "utf-8" if encoding == "utf-8-sig" else encoding, "delimiter": delimiter}


def read_sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV in whatever encoding and delimiter its head shows, all text.

    Spark's CSV reader knows no GB18030. Its line feeds are plain bytes,
    though, so lines are read as bytes, decoded in batches and then parsed."""
    form = sniff_csv(spark, path)
    if form["encoding"] != "gb18030":
        return spark.read.option("header", True).option("encoding", form["encoding"]).option("sep", form["delimiter"]).csv(path)
    header = files.head(spark, path, 65_536).split(b"\n")[0].decode("gb18030").rstrip("\r")
    names = next(csv.reader([header], delimiter=form["delimiter"]))

    @F.pandas_udf("string")
    def decoded(lines: pd.Series) -> pd.Series:
        return lines.map(lambda b: bytes(b).decode("gb18030", "replace"))

    lines = spark.read.text(path).select(decoded(F.col("value").cast("binary")).alias("line")).where((F.col("line") != header) & (F.trim("line") != ""))
    schema = ", ".join(f"`{n or f'_c{i}'}` string" for i, n in enumerate(names))
    return lines.select(F.from_csv("line", schema, {"sep": form["delimiter"]}).alias("r")).select("r.*")


def read_csv_rows(spark: SparkSession, path: str, most: int = 1000) -> list[dict[str, str]]:
    """The first rows of a CSV as dictionaries of text, ``most`` at most; for
    whole tables read a DataFrame."""
    return [r.asDict() for r in read_sniffed_csv(spark, path).limit(most).collect()]


def count_csv_rows(spark: SparkSession, path: str) -> int:
    """Physical rows of a CSV, its header included."""
    return spark.read.option("header", False).csv(path).count()


def read_commented_tsv(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Tab-separated text with comment lines; unnamed columns are dropped."""
    df = spark.read.option("header", True).option("sep", "\t").option("comment", comment).option("inferSchema", True).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c and not re.match(r"_c\d+$|Unnamed:", c)])


def read_fixed_grid(spark: SparkSession, path: str, sentinel: float = -99.999) -> DataFrame:
    """Lines of white-space separated numbers, a year first: (year, cell, value)
    with cells from 0 and the sentinel as null."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(
        F.col("p")[0].cast("double").cast("int").alias("year"), F.posexplode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("cell", "v")
    ).select("year", "cell", F.nullif(F.col("v").try_cast("double"), F.lit(float(sentinel))).alias("value"))


def datasets_below(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Files of a suffix below a folder; a table that is a folder counts once."""
    found = [m[1] for f in files.files_below(spark, root) if (m := re.match(rf"(.*?{re.escape(suffix)})(/|$)", f))]
    return sorted(set(found))


def discover_dataset(spark: SparkSession, run_dir: str, manifest: str = "run_manifest.json") -> str:
    """The manifest's input_path where it exists, else the first Parquet table
    below the folder, else the first CSV."""
    root = str(run_dir).rstrip("/")
    if files.exists(spark, f"{root}/{manifest}"):
        path = json.loads(files.read_text(spark, f"{root}/{manifest}")).get("input_path")
        if path and files.exists(spark, path):
            return str(path)
    for suffix in (".parquet", ".csv"):
        found = datasets_below(spark, root, suffix)
        if found:
            return found[0]
    raise FileNotFoundError(f"no dataset below {root}")


def ratio_label(path: Column) -> Column:
    """``1:N`` from a path that holds ratio_1_N, else null."""
    n = F.regexp_extract(path, r"ratio_1_(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("1:"), n))


def ratio_datasets(spark: SparkSession, root: str, ratios: Sequence[int]) -> dict[int, str]:
    """The dataset of each ratio below ``root``; all must exist."""
    paths = sorted(p for suffix in (".parquet", ".csv") for p in datasets_below(spark, root, suffix))
    found = {int(m[1]): p for p in paths if (m := re.search(r"ratio_1_(\d+)", p))}
    missing = [r for r in ratios if r not in found]
    if missing:
        raise FileNotFoundError(f"no dataset of ratio {missing}")
    return {r: found[r] for r in ratios}


def flatten_paths(tree: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested configuration as dotted keys."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        out |= flatten_paths(v, key) if isinstance(v, dict) else {key: v}
    return out


def load_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON configuration, or YAML where a YAML library is installed."""
    text = files.read_text(spark, path)
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML needs a YAML library; use JSON") from e
    return yaml.safe_load(text)
