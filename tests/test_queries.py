"""Every registered query with SQL is held against DuckDB on the small tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tremor.plans import catalogue

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    pd.testing.assert_frame_equal(normal(entry.queries()[name](spark, sf_dir).toPandas()), normal(duck.execute(SQL[name]).df()), check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 60
