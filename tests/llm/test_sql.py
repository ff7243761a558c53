"""Operators that SQL can express, against DuckDB on the given tables."""

import pytest

import __spark_entry__ as registry
from oracle.compare import connect, difference

from trailmark.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows(spark, name):
    assert difference(registry.queries()[name](spark, SF_DIR), connect(SF_DIR), queries.oracle_sql()[name]) is None
