"""Every query with SQL against DuckDB over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from kilnwork.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v) + 0.0:.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = sql.sql(registry.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    at = [list(want.columns).index(c) for c in names]
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
