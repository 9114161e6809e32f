"""Every registered query against its SQL twin at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
from check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registered.queries()))
def test_equals_sql(spark, sql, name):
    df = registered.queries()[name](spark, FOLDER)
    got = df.collect()
    assert got
    if name in registered.oracle_sql():
        cursor = sql.execute(registered.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
