"""Every query with an SQL twin gives the same rows in DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle import compare, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, con, name):
    assert compare(spark, folder, queries()[name], SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_without_sql_runs(spark, folder, name):
    df = queries()[name](spark, folder)
    assert df.count() > 0
