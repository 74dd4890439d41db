"""Every registered query against its SQL twin in DuckDB."""

import pytest

import __spark_entry__ as entry_points
import harness
from harness import SMALL

QUERIES = {name: run for name, run in entry_points.queries().items() if name not in entry_points.CORPUS}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name not in entry_points.CORPUS}


@pytest.fixture(scope="module")
def connection():
    return harness.duck(SMALL)


def test_every_query_has_a_twin():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, connection, name):
    assert harness.differences(QUERIES[name](spark, SMALL), connection, SQL[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3640
