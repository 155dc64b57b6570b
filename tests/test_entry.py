"""The driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60 and all(callable(f) for f in q.values())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["grid_summary", "nearest_center", "word_network", "node_degrees", "linear_histogram", "expected_visits"])
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(str, df[cols].round(9).itertuples(index=False, name=None)))
    assert key(got) == key(want)
