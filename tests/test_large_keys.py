"""Queries over chapters give what DuckDB gives where keys are as large and as far apart as in sixty copies of sf0.1."""

from __future__ import annotations

import os

import pytest
from support import database, differences

from pageloom.plans import registry

NAMES = "fix_05_cals udf_04_fixer fix_02_formal fix_09_models fix_17_targeted agg_27_improvement fix_07_bridgeheads fix_14_space fix_18_chain fix_08_media fix_16_core".split()


@pytest.fixture(scope="module")
def large(small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large_keys")
    for name in os.listdir(small):
        if name != "lineitem.parquet":
            (folder / name).symlink_to(f"{small}/{name}")
    keys = "l_orderkey + 8850000 AS l_orderkey, l_partkey + l_linenumber % 2 * 1199000 AS l_partkey, l_suppkey * 7919 % 60000 AS l_suppkey"
    database(small).execute(f"COPY (SELECT * REPLACE ({keys}) FROM lineitem WHERE l_orderkey % 4 = 0) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql_with_large_keys(spark, large, name):
    assert differences(registry.QUERIES[name](spark, large), database(large), registry.ORACLE_SQL[name]) == []
