"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(SQLS))
def test_query_equals_sql(spark, duck, key):
    assert compare(spark, duck, SF, QUERIES[key], SQLS[key]) == ""


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)
