"""Every registered query runs at the smallest scale; those with a SQL twin must give the same rows."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tablemill.plans.registry import TABLES
from tools.check import norm

FOLDER = os.environ.get("TABLEMILL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(row[c]) for c in columns) for row in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == columns
    assert got == Counter(tuple(norm(r[i]) for i in order) for r in result.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_oracle_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
