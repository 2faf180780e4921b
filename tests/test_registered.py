"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from metricloom.plans import workload

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
QUERIES, ORACLES = workload.QUERIES, workload.ORACLES

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no benchmark tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    number = float(value)
    return "NaN" if math.isnan(number) else (int(value) if number == int(value) else number)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_module.queries().keys()
    assert ORACLES.keys() <= entry_module.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(expected.columns)
    got = rows_of(result.columns, result.collect())
    assert got == rows_of(expected.columns, expected.fetchall())


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["time", "value", "series"] and result.count() > 0
