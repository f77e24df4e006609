"""The registered queries of this package against their SQL, on the sf0.01 tables."""

import pytest

from frostgrid.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import canonical, run_sql
from tests.test_oracle import SF_DIR, SPARK_TO_DUCKDB

TYPES = {**SPARK_TO_DUCKDB, "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    names, types, expected = run_sql(ORACLE_SQL[name], SF_DIR)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    got = df.collect()
    assert len(got) == len(expected) > 0
    assert canonical(df.columns, got) == canonical(names, expected)
