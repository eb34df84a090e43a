"""Every query with SQL against DuckDB on the same tables, value for value."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False)), key=str) for x in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
    assert rows[0]


def test_entry(spark):
    assert entry.entry(spark).count() == 500
