import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalog.llm import entries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, DIR)
    cell = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) else x
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({entries.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(map(cell, r))) for r in want)
