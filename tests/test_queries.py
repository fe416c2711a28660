"""Every registered base query against its DuckDB oracle at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from stratalog.plans import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    def cell(x):
        if not isinstance(x, (list, tuple)) and pd.isna(x):
            return "NULL"
        if hasattr(x, "year"):
            return str(pd.Timestamp(x))
        return repr(round(float(x), 9)) if isinstance(x, (int, float)) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(Q.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert Q.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
