"""Every registered query against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def norm(v):
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not re.match(r"op\d+_", n)])
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    r = duck.execute(__spark_entry__.oracle_sql()[name])
    columns, want = [x[0] for x in r.description], r.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(norm(x[c]) for c in order) for x in df.collect()), key=repr)
    assert got == sorted((tuple(norm(x[columns.index(c)]) for c in order) for x in want), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
