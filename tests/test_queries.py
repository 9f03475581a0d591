import os

import duckdb
import pytest

import __spark_entry__
from folioscope.plans import load_queries

QUERIES, SQL = load_queries()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return c


def shown(v):
    if v is None or v != v:
        return "none"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert mine == theirs


def test_every_query_has_a_twin_or_a_test():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
