"""Every registered query against its SQL, on the sf0.01 tables."""

import pytest

import __spark_entry__ as entry
from frostgrid.plans import ORACLE_SQL
from tests.oracle import canonical, run_sql

SF_DIR = "/root/testdata/sf0.01"
SPARK_TO_DUCKDB = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    names, types, expected = run_sql(entry.oracle_sql()[name], SF_DIR)
    assert {f.name: SPARK_TO_DUCKDB[f.dataType.simpleString()] for f in df.schema} == types
    got = df.collect()
    assert len(got) == len(expected) > 0
    assert canonical(df.columns, got) == canonical(names, expected)


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
