"""Every query with SQL agrees with it on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from silvergrain.plans import registry


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    rows = df.collect()
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in rows), key=repr)
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got == expected


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
