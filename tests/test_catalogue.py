import os

import duckdb
import pytest

import __spark_entry__
from colform import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


def cell(x):
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    relation = tables.sql(catalogue.ORACLES[name])
    assert sorted(relation.columns) == columns
    want = relation.select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(tuple(map(cell, r)) for r in rows) == sorted(tuple(map(cell, r)) for r in want)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
