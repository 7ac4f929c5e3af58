"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into ``SLOTS`` slots. The bytes of each slot are aggregated, and a
versioned map in a store says which shard a slot lies in. Rebalancing edits the
latest version, moving few slots, and adds the next; records never change their slot. The map and the slots' totals have
``SLOTS`` rows whatever the number of records, so they may be collected and
broadcast.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpoint

SLOTS, SHARDS, LAW = 4096, 8, "bytes"


@dataclass(frozen=True)
class SlotMap:
    """``owner[slot]`` is the slot's shard."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def initial(cls, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return cls(0, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, weights: list[int]) -> SlotMap:
        """The next version: slots move, or trade places, from the heaviest to the lightest shard while that evens them out."""
        owner = list(self.owner)
        load = [0] * self.shards
        held: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            load[shard] += weights[slot]
            if weights[slot]:
                held[shard].add(slot)
        while True:
            most, least = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[most] - load[least]
            # what moves must be less than the gap, best half of it
            best, give, take = gap, None, None
            for slot in held[most]:
                if (off := abs(gap - 2 * weights[slot])) < best:
                    best, give, take = off, slot, None
            if best * 4 > gap:  # no single slot comes near: two that differ by about half the gap trade places
                theirs = sorted(held[least], key=weights.__getitem__)
                values = [weights[s] for s in theirs]
                for slot in held[most]:
                    at = bisect_left(values, weights[slot] - gap / 2)
                    for k in (at - 1, at):
                        if 0 <= k < len(theirs) and (off := abs(gap - 2 * (weights[slot] - values[k]))) < best:
                            best, give, take = off, slot, theirs[k]
            if give is None:
                return replace(self, version=self.version + 1, owner=tuple(owner))
            for slot, a, b in [(give, most, least), *([(take, least, most)] if take is not None else [])]:
                owner[slot] = b
                held[a].remove(slot)
                held[b].add(slot)
                load[a] -= weights[slot]
                load[b] += weights[slot]

    def grown(self, weights: list[int]) -> SlotMap:
        """The next version with one more, still empty shard, filled by moves into it only as far as an even share."""
        bigger = replace(self, shards=self.shards + 1)
        return bigger.rebalanced(weights)

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(version, shards, slot, shard)``."""
        owners = F.from_json(F.lit(json.dumps(self.owner)), "array<int>")
        return spark.range(len(self.owner)).select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), F.col("id").cast("int").alias("slot"), F.get(owners, F.col("id").cast("int")).alias("shard"))

    def save(self, spark: SparkSession, store: str) -> None:
        """Add this version to the store; one that is already there is an error and stays as it is."""
        self.rows(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{store}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, store: str, version: int) -> SlotMap:
        rows = sorted((r["slot"], r["shard"], r["shards"]) for r in spark.read.parquet(f"{store}/version={version}").collect())
        return cls(version, rows[0][2], tuple(s for _, s, _ in rows))

    @classmethod
    def latest(cls, spark: SparkSession, store: str) -> SlotMap | None:
        """The highest version in the store; None if it has none."""
        try:
            versions = spark.read.parquet(store).agg(F.max("version")).first()[0]
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return None if versions is None else cls.load(spark, store, int(versions))


def maintained(spark: SparkSession, store: str, weights: list[int], shards: int) -> SlotMap:
    """The map to use: the latest of the store, grown to ``shards`` and rebalanced. What changed is saved as further versions."""
    now = SlotMap.latest(spark, store)
    if now is None:
        now = SlotMap.initial(len(weights), shards)
        now.save(spark, store)
    if len(now.owner) != len(weights) or now.shards > shards:
        raise ValueError(f"the store has {len(now.owner)} slots in {now.shards} shards; slots are fixed and shards only grow")
    while now.shards < shards:
        now = now.grown(weights)
        now.save(spark, store)
    after = now.rebalanced(weights)
    if after.owner == now.owner:
        return now
    after.save(spark, store)
    return SlotMap.load(spark, store, after.version)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(id_col, size, text_crc32, virtual_slot)``. Copies of a text have ids of their own and so spread over the slots."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    sized = df.select(F.col(id_col), text_size(F.col(text_col)).alias("size"), crc.alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(slots)).cast("int"))


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot; at most ``slots`` rows reach the driver."""
    out = [0] * slots
    for slot, size in rows.groupBy("virtual_slot").agg(F.sum("size")).collect():
        out[slot] = size
    return out


def place(rows: DataFrame, placing: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's place in its shard, gapless from 0."""
    where = placing.rows(rows.sparkSession).select(F.col("slot").alias("virtual_slot"), "shard")
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("__n"))
    before = W.Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.Window.unboundedPreceding, -1)
    based = where.join(counts, "virtual_slot").withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = W.Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("__in", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(based), "virtual_slot").withColumn("slot", (F.col("__base") + F.col("__in")).cast("bigint")).drop("__base", "__in")


def shard(df: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``(virtual_slot, id_col, size, text_crc32, shard, slot)`` with shards of near equal bytes.

    Null texts count no bytes, and every row one more than its bytes. Rows that
    repeat an id and a text share a virtual slot but have places of their own;
    null ids hash by their text; other columns are not read; an empty table gives
    an empty result. The map is the latest of ``store``, or an even one if it has
    none, rebalanced for the bytes of ``df``; each change adds a version. A map of
    other slots, or of more shards than asked for, raises an error.
    """
    spark = df.sparkSession
    rows = checkpoint(slotted(df, id_col, text_col, slots))
    return place(rows, maintained(spark, store, slot_weights(rows, slots), shards), id_col)
