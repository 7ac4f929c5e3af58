"""Packing of tokenised documents by cutting-stock column generation.

1. One Arrow pass encodes every document and cuts it at multiples of the
   sequence length; the last piece is the remainder. Only piece lengths go on.
2. Lengths are counted in classes of ``UNIT`` tokens: a histogram with a fixed
   number of rows, whatever the corpus.
3. On the driver a linear program over cutting patterns is solved by column
   generation: a revised simplex keeps the basis, an unbounded knapsack by dynamic
   programming prices new patterns. Patterns are rounded down and the bounded rest
   is placed first-fit decreasing.
4. Full pieces are sequences of their own. The others are ranked inside their
   class (salted by its count, so a hot length is no hot task) and each range of
   ranks goes to the instances of one pattern.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..shipping import ship
from .common import checkpoint

CAPACITY, UNIT, END_ID = 4096, 16, 2
#: Rows that are ranked in one window; a class has as many salts as it needs for that.
RANKED = 65_536
#: Salted classes are broadcast with their first ranks up to so many.
MOST_BROADCAST = 500_000
#: The linear program ends when its value is proven to lie within this share of the optimum.
GAP = 0.002
#: Weight of the best prices so far in those a round tries first, which steadies column generation.
STEADY = 0.8
TOKENIZER = "word_bpe_49k.json"
#: Words in each of the two generations that a worker remembers.
MOST_WORDS, LONGEST_WORD = 300_000, 256

_LETTERS, _NUMBERS = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: A text with any other character goes through the tokenizer library as a whole.
_UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-įı-ſ]")
#: The tokenizer's own pre-split, for lower-case texts of those characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: visible Latin-1 characters for themselves, the rest in order from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


_LETTERS_OF = _byte_letters()


class WordEncoder(dict):
    """Ids of texts as little-endian bytes. Words are encoded apart by the tokenizer, so each distinct word is encoded once."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One lower-case piece of the pre-split by the model alone; normalizer and pre-split leave such a piece as it is."""
        letters = word if word.isascii() else "".join(map(_LETTERS_OF.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._word(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:  # words used since the last change stay known for another
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))


@cache
def _encoder(spec: str) -> WordEncoder:
    return WordEncoder(spec)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, checksum: bool = False) -> DataFrame:
    """``(id_col, start, length, ids, doc_tokens)``: each document's ids, then ``end_id``, cut every ``capacity`` ids.

    ``ids`` holds little-endian unsigned 32-bit ids; with ``checksum`` there is
    their CRC-32 as ``ids_crc32`` instead, and no ids leave Python. A null text counts as empty
    and still has ``end_id``; repeated rows are cut each; other columns are not
    read; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary file
    narrow = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    end = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity
    name, kind, made = ("ids_crc32", pa.int64(), zlib.crc32) if checksum else ("ids", pa.binary(), bytes)

    def run(batches):
        encoder = _encoder(spec.value)
        for batch in batches:
            ids, rows = batch.column(0), []
            held = 0

            def out(rows=rows, ids=ids):
                who, start, length, data, total = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(who)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, kind), pa.array(total, pa.int64())],
                    names=[id_col, "start", "length", name, "doc_tokens"],
                )

            for i, text in enumerate(batch.column(1)):
                data = encoder.encode(text.as_py() or "") + end
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append((i, at // 4, len(part) // 4, made(part), len(data) // 4))
                held += 64 if checksum else len(data)
                if held > 1 << 24:
                    yield out()
                    rows.clear()
                    held = 0
            if rows:
                yield out()

    id_type = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, start bigint, length bigint, {name} {'bigint' if checksum else 'binary'}, doc_tokens bigint")


def _best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    worth = np.full(int(sizes[-1]) + 1, -np.inf)
    worth[sizes] = values
    which = np.zeros(len(worth), np.int64)
    which[sizes] = np.arange(len(sizes))
    worth, which = worth[1:], which[1:]
    for c in range(1, room + 1):
        n = min(c, len(worth))
        total = best[c - n : c][::-1] + worth[:n]
        k = total.argmax()
        if total[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = total[k], which[k]
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many pieces of each size) and how often each is used, meeting the demand exactly at most.

    ``sizes`` ascend and fit the room; every unit of demand lies in exactly one use of a pattern.
    """
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    x = inverse @ demand
    centre, bound = sizes / room, 0.0  # the best feasible prices so far, and the bound they prove
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        found = None
        for trial in (STEADY * centre + (1 - STEADY) * prices, prices):  # smoothed prices first
            worth, pattern = _best_pattern(trial, sizes, room)
            proven = trial / max(worth, 1.0)
            if proven @ demand > bound:
                centre, bound = proven, float(proven @ demand)
            if prices @ pattern > 1 + 1e-9:
                found = pattern
                break
        if found is None or x.sum() <= (1 + gap) * bound:
            break
        pattern = found
        y = inverse @ pattern
        up = y > 1e-9
        ratio = np.where(up, x / np.where(up, y, 1.0), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        row = inverse[out] / y[out]
        inverse -= np.outer(y, row)
        inverse[out] = row
        x = np.maximum(inverse @ demand, 0.0)
    plan, left = [], demand.copy()
    for k in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    rest: Counter = Counter()
    bins: list[list] = []  # room left and pieces, of what rounding leaves over: fewer than the basis has patterns
    for j in np.nonzero(left)[0][::-1]:
        for _ in range(int(left[j])):
            place = next((b for b in bins if b[0] >= sizes[j]), None)
            if place is None:
                bins.append(place := [room, []])
            place[0] -= sizes[j]
            place[1].append(int(j))
    for _, held in bins:
        rest[tuple(held)] += 1
    for held, times in rest.items():
        plan.append((np.bincount(held, minlength=m).astype(np.int64), times))
    return plan


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, unit: int = UNIT, ranked: int = RANKED, tie: str | None = None) -> DataFrame:
    """``cut`` (``id_col, start, length``, others stay) with ``sequence_id`` and ``offset``.

    Every piece lies in one sequence of at most ``capacity`` tokens, gapless from
    offset 0. Packed sequences are numbered from 0; full pieces, which need no
    packing, have negative ids of their own. ``tie`` names a further column that
    tells pieces of equal ids apart. An empty table gives an empty result; columns
    named as a result are replaced. ``cut`` is read several times: pass a stored
    table, whose row order is fixed.
    """
    spark = cut.sparkSession
    room = capacity // unit
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    rows = cut.select(*kept)
    full = rows.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    tied = [id_col, "start", *([tie] if tie else [])]
    classed = rows.filter(F.col("length") < capacity).withColumn("__class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = sorted((r[0], r[1]) for r in classed.groupBy("__class").agg(F.count(F.lit(1))).collect())  # at most ``room`` rows
    sizes, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    salts = F.create_map(*(F.lit(x) for c, n in histogram for x in (c, -(-n // ranked)))) if histogram else F.create_map().cast("map<int,int>")
    salted = classed.withColumn("__salt", F.pmod(F.xxhash64(*tied), F.try_element_at(salts, F.col("__class"))).cast("int"))
    counts = checkpoint(salted.groupBy("__class", "__salt").agg(F.count(F.lit(1)).alias("__n")))
    segments, taken, sequence = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in cutting_stock(sizes, demand, room):
        lane = 0
        for j in np.nonzero(pattern)[0]:
            many = int(pattern[j])
            segments.append((int(sizes[j]), int(taken[j]), int(taken[j]) + many * times, sequence, many, lane))
            taken[j] += many * times
            lane += many
        sequence += times
    # a few rows for each basis pattern and left-over bin: bounded by the number of classes, not by the corpus
    plan = spark.createDataFrame(segments, "__c int, __low long, __high long, __first long, __many long, __lane long")
    before = W.Window.partitionBy("__class").orderBy("__salt").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = counts.select("__class", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    bases = F.broadcast(bases) if sum(-(-n // ranked) for _, n in histogram) <= MOST_BROADCAST else bases
    inside = W.Window.partitionBy("__class", "__salt").orderBy(*tied)
    placed = salted.withColumn("__in", F.row_number().over(inside) - 1).join(bases, ["__class", "__salt"]).withColumn("__rank", F.col("__in") + F.col("__base"))
    placed = placed.join(F.broadcast(plan), (F.col("__class") == F.col("__c")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    ahead = F.col("__rank") - F.col("__low")
    placed = placed.withColumn("sequence_id", F.col("__first") + F.floor(ahead / F.col("__many")).cast("bigint")).withColumn("__at", F.col("__lane") + ahead % F.col("__many"))
    earlier = W.Window.partitionBy("sequence_id").orderBy("__at").rowsBetween(W.Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("bigint"))
    return out.select(*kept, "sequence_id", "offset").union(full.select(*kept, "sequence_id", "offset"))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place: ``pieces`` and ``pack``, carrying a checksum of the ids instead of the ids."""
    return pack(checkpoint(pieces(df, id_col, text_col, tokenizer, checksum=True)), id_col, tie="ids_crc32")
