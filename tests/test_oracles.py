"""Registered queries against their DuckDB SQL, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__
from epispark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.sql(registry.ORACLES[name])
    columns = found.columns
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, found.fetchall())


def test_queries_without_sql_have_tests_of_their_values():
    with open(os.path.join(os.path.dirname(__file__), "test_models.py")) as f:
        text = f.read()
    assert all(f'"{name}"' in text for name in set(registry.QUERIES) - set(registry.ORACLES))


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
