"""Every query with SQL gives the rows of that SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from terrasieve import model_queries, table_queries  # noqa: F401  (they add their queries)
from terrasieve import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and u == pytest.approx(v, abs=2e-4) or str(u) == str(v) for u, v in zip(x, y)), (x, y)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
