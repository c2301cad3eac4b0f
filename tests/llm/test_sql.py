"""The operators' queries against their SQL."""

import os

import duckdb
import pytest

from tempograph.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
