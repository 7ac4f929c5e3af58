"""Training-data queries that SQL can express give what DuckDB gives on the small tables."""

from __future__ import annotations

import pytest
from support import database, differences

from pageloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert differences(registry.QUERIES[name](spark, small), database(small), registry.ORACLE_SQL[name]) == []
