"""Each query with an oracle gives the rows that its SQL gives."""

import math
import os

import duckdb
import pytest

from quillon import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(small):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{small}/{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return round(value, 4) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
