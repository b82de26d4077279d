"""The driver's entry points, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import hotleaf.plans.management as documents

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


def rows(columns, records):
    return sorted(tuple("" if r[c] is None else str(r[c]) for c in columns) for r in records)


@needs_data
@pytest.mark.parametrize("name", sorted(documents.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(documents.ORACLE_SQL[name])
    got = documents.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(columns, got.collect()) == rows(columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


def test_every_query_is_registered():
    assert set(documents.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
