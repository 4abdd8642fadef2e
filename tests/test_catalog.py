"""Driver contract: every catalogue query runs at sf0.001 and equals its
DuckDB twin (row multiset, column names)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from linkloom.catalog import QUERIES
from linkloom.oracle import SQL

TABLES = "customer events documents pages".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def test_contract_shape():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 10 and "rank" in df.columns


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_query_equals_oracle(spark, con, sf, name):
    df = E.queries()[name](spark, sf)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    a = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    di = [dcols.index(c) for c in order]
    b = sorted((tuple(norm(r[i]) for i in di) for r in res.fetchall()), key=repr)
    assert a == b
