"""Every query with SQL gives the SQL's rows; the others give rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as e
from tempograph.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = sorted(catalogue.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return connection


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else round(x, 8) + 0.0
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    want = table([c[0] for c in want.description], want.fetchall())
    got = table(found.columns, found.collect())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
