"""Every registered relational query against its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(cell, v))
    if pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        return round(float(v), 6)  # a column with nulls comes as doubles
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(cell, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, data, name):
    mine, theirs = catalog.QUERIES[name](spark, data).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
