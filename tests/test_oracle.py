"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__

TABLES = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.sql(f"create view {f.split('.')[0]} as select * from '{TABLES}/{f}'")
    return c


def rows(found, columns):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(value(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, TABLES)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
