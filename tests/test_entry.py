"""The entry module: registry, flagship query, and every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from rowloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    if name in registry.ORACLES:
        con = duckdb.connect()
        for file in os.listdir(SF):
            con.sql(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
        found = con.sql(registry.ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
