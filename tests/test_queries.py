"""Every query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sessionscope.catalog.oracle import SELECTS, statement
from sessionscope.catalog.queries import QUERIES
from tests.check import connect, oracle_rows, spark_rows, type_differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SELECTS)
    assert set(QUERIES) <= set(entry.queries()) and set(SELECTS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns, rows = spark_rows(frame)
    oracle_columns, expected = oracle_rows(connection, statement(name))
    assert columns == oracle_columns
    assert rows == expected
    assert rows
    assert type_differences(frame, connection, statement(name)) == {}
