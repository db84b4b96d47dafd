"""Every registered query runs on the smallest tables; those with SQL match it."""

import glob
import os

import duckdb
import pytest

from tracemill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, name):
    got = Q.QUERIES[name](spark, sf).toPandas()
    if name in Q.ORACLE:
        con = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = con.execute(Q.ORACLE[name]).df()
        assert sorted(map(tuple, got[sorted(got.columns)].values)) == sorted(map(tuple, want[sorted(want.columns)].values))


COLUMNS = {
    "p1_found": "mix_id bigint",
    "p2_found": "tab string, rec_id bigint, msg_no bigint",
    "p4_found": "case_id_a bigint, case_id_b bigint",
    "p5_found": "tab string, rec_id bigint, msg_no bigint, defect string",
    "p6_ids": "doc_id bigint, ids array<int>",
    "p7_found": "spec_name string, doc_id bigint",
    "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert df.count() == df.distinct().count()
