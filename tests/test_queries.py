"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from stormgrid.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in registry.TABLES:
        path = f"{SF_DIR}/{name}.parquet"
        con.sql(f"create view {name} as from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else float(v))
        elif "datetime" in str(df[c].dtype) or df[c].map(type).astype(str).str.contains("date").any():
            df[c] = pd.to_datetime(df[c]).map(str)
    return sorted((tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_is_named_once():
    names = registry.queries()
    assert len(names) > 180 and set(SQL) <= set(names)
