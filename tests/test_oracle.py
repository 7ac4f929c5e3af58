"""Every query with SQL gives what DuckDB gives on the small tables; every other one runs."""

from __future__ import annotations

import pytest
from support import database, differences

from pageloom.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, small, con, name):
    assert differences(registry.QUERIES[name](spark, small), con, registry.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).collect() is not None


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
