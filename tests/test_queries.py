"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.compare import duck_rows, spark_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    columns, rows, _ = spark_rows(QUERIES[name](spark, FOLDER))
    other_columns, other, _ = duck_rows(FOLDER, SQL[name])
    assert columns == other_columns
    assert rows == other


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["topic", "n_covered", "n", "p"]
