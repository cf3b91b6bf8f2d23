"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables where they exist."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(row):
    return tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(plain(r[c] for c in columns) for r in df.collect())
    r = duck.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == columns
    want = Counter(plain(dict(zip(r.columns, x))[c] for c in columns) for x in r.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 36


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
