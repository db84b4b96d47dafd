"""Every query against its SQL on the smallest tables; queries without SQL must run and keep their columns."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracemill import plans


def rows(df):
    def cell(x):
        if isinstance(x, float):
            return "NULL" if pd.isna(x) else f"{x:.6g}"
        if isinstance(x, pd.Timestamp):
            return str(x.date()) if x == x.normalize() else str(x)
        return "NULL" if x is None or x is pd.NaT or x is pd.NA else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    if name in plans.ORACLE:
        want = duck.execute(plans.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
