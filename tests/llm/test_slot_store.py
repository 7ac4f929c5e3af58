"""The stored slot map is edited from its latest version."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import AnalysisException

from pageloom.llm import sharding

SCHEMA = "doc_id long, text string"


def docs(spark, n, long=0):
    return spark.createDataFrame([(i, "x" * (i % 97) + "y" * (5000 if i % 1000 < long else 0)) for i in range(n)], SCHEMA)


def test_a_second_run_edits_the_latest_map(spark, tmp_path):
    store = str(tmp_path / "maps")
    assert sharding.SlotMap.latest(spark, store) is None
    first = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, 3000), store).collect()}
    one = sharding.SlotMap.latest(spark, store)
    assert one.version == 1 and one.shards == sharding.SHARDS
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, 3000), store).collect()}
    assert again == first and sharding.SlotMap.latest(spark, store) == one  # nothing to edit, no new version
    more = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, 3300, long=30), store).collect()}
    two = sharding.SlotMap.latest(spark, store)
    assert two.version == 2 and sharding.SlotMap.load(spark, store, 1) == one
    assert sum(a != b for a, b in zip(one.owner, two.owner, strict=True)) < 0.2 * sharding.SLOTS
    assert sum(more[i] != first[i] for i in first) < 0.3 * len(first)


def test_versions_are_never_overwritten(spark, tmp_path):
    store = str(tmp_path / "maps")
    first = sharding.SlotMap.initial(64, 8)
    first.save(spark, store)
    with pytest.raises(AnalysisException):
        first.rebalanced([1] * 64).__class__(0, 8, tuple([0] * 64)).save(spark, store)
    assert sharding.SlotMap.load(spark, store, 0) == first


def test_empty_shards_stay_in_the_map(spark, tmp_path):
    store = str(tmp_path / "maps")
    few = sharding.SlotMap.initial(4, 8)
    few.save(spark, store)
    assert sharding.SlotMap.load(spark, store, 0) == few and sharding.SlotMap.latest(spark, store).shards == 8


def test_growth_adds_a_shard_and_keeps_most_rows(spark, tmp_path):
    store = str(tmp_path / "maps")
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, 3000), store).collect()}
    after = {r["doc_id"]: (r["shard"], r["size"]) for r in sharding.shard(docs(spark, 3000), store, shards=9).collect()}
    load = Counter()
    for shard, size in after.values():
        load[shard] += size
    assert set(load) == set(range(9)) and max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    assert sum(after[i][0] != before[i] for i in before) < 0.25 * len(before)
    with pytest.raises(ValueError, match="only grow"):
        sharding.shard(docs(spark, 10), store, shards=8)
    with pytest.raises(ValueError, match="slots are fixed"):
        sharding.shard(docs(spark, 10), store, shards=9, slots=64)
