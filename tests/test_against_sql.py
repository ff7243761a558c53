"""Every registered query against its SQL equivalent."""

import pytest

import __spark_entry__ as registry
from event_rows import SF_DIR
from oracle.compare import connect, difference
from oracle.statements import all_statements

STATEMENTS = all_statements()
QUERIES = {name: query for name, query in registry.queries().items() if name in STATEMENTS}

# DuckDB types of the Spark types in results.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_each_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_and_types(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, STATEMENTS[name]) is None
    types = {c[0]: str(c[1]) for c in con.execute(STATEMENTS[name]).description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[0] == "channel_group"
    assert df.count() == 10
