"""The engine's queries against their SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from heapsift.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
