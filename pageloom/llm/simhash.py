"""SimHash near-duplicate classes by bit-sliced comparison.

1. Every text becomes a fingerprint of its word shingles (one Arrow pass): 64 bits,
   or several words of 64 bits from the same shingle hashes.
2. Rows collapse to distinct fingerprints, so copies cost nothing further.
3. Fingerprints meet in buckets. Two of 64 bits within a small ``radius`` agree on at
   least one of ``radius + 1`` bands, so each goes to one bucket per band; a bucket
   over ``BUCKET`` entries is split again by the same rule on its remaining bits.
   Wide fingerprints, whose radius is too large for that, meet where they agree
   on any 16 neighbouring bits of a stride. A bucket that is still too large is
   cut into tiles: every pair of chunks meets in exactly one tile. No candidate is
   dropped at any level.
4. Inside a bucket the fingerprints lie in 64-lane blocks, one machine word for each
   bit plane. One comparison holds a fingerprint against a block: the planes are
   XORed and added to carry-save counters, and it is abandoned as soon as every
   lane is over the radius.
5. A bucket returns only a spanning forest of its links; the forests are joined
   by distributed connected components.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, shuffle_partitions
from .components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Shingles and fingerprint words of ``drop_near_duplicates``, and the Jaccard similarity of shingle sets from which texts are near duplicates.
NEAR_SHINGLE, NEAR_WORDS, SIMILARITY = 5, 4, 0.8
#: Bits of a bucket's key of wide fingerprints, and how far the next key begins.
KEY_BITS, STRIDE = 16, 8
#: Largest bucket compared as it is; larger ones are split by their other bits, then tiled.
BUCKET = 1024
#: Buckets up to this size would leave most lanes of a block empty; their few pairs are compared one by one.
FEW = 16
#: A tiled bucket is cut into so many chunks at most, which bounds how often a row is sent.
MOST_CHUNKS = 64
#: Rows (an id and a hash each) that may be broadcast to tell which documents go, or which keys are hot; beyond, they are joined by their keys.
MOST_BROADCAST = 1_000_000
#: Shingles hashed at a time, which bounds memory for very long texts.
WINDOW = 1 << 17
#: Blocks turned into planes at a time.
BLOCKS = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each 64-bit hash and ``words - 1`` mixtures of it (the finalizer of SplitMix64), shape (n, words)."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """The fingerprint of one UTF-8 text as unsigned words; zero if it is null or has no word."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(words, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) < size:
        return _spread(np.array([digest(join(found), seed)], np.uint64), words)[0]
    n = len(found) - size + 1
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, n, WINDOW):
        part = found[at : min(at + WINDOW, n) + size - 1]
        shingles = map(join, zip(*(part[k:] for k in range(size)), strict=False))
        hashes = _spread(np.fromiter(map(digest, shingles, repeat(seed)), np.uint64, len(part) - size + 1), words)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(hashes), 8 * words), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums that fit a byte are added eight lanes and more at a time
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fp_columns(words: int) -> list[str]:
    return ["fp"] if words == 1 else [f"fp{k}" for k in range(words)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED, words: int = 1) -> DataFrame:
    """``(id_col, fp)`` for every row: the fingerprint as a signed long, or as columns ``fp0, fp1 ...`` if it has several words.

    A null or wordless text has fingerprint 0. Repeated rows and null ids stay;
    other columns are not read.
    """
    ship(df.sparkSession)
    narrow = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    names = fp_columns(words)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size, seed, words) for t in batch.column(1)], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(words))], names=[id_col, *names])

    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} bigint" for n in names)]))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints, shape (blocks, 64, words), as vertical planes, shape (64 * words, blocks)."""
    blocks, _, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(blocks, 64, 8 * words), axis=2, bitorder="little")
    lanes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view("<u8").reshape(64 * words, blocks)


def within(planes: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int) -> np.ndarray:
    """For comparison i, the mask of lanes of block ``blocks[i]`` within ``radius`` bits of ``queries[i]``, a row of words."""
    width = radius.bit_length()
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    counters = [np.zeros(len(queries), np.uint64) for _ in range(width)]
    over = np.zeros(len(queries), np.uint64)
    q, at = queries, blocks
    for bit in range(len(planes)):
        carry = planes[bit, at] ^ (np.uint64(0) - ((q[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)))
        for c in counters:
            carry_on = c & carry
            c ^= carry
            carry = carry_on
        over |= carry
        look = bit % 8 == 7
        if radius + 1 != 1 << width and (look or radius < 8):
            # the counters can hold more than the radius: mark the lanes beyond it
            above = np.zeros_like(over)
            equal = np.full_like(over, ALL)
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            over |= above
        if look and bit + 1 < len(planes):
            keep = over != ALL
            if not keep.all():
                live, q, at, over = live[keep], q[keep], at[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; ``label`` maps each item to an item no larger than it."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt


def bucket_links(fps: np.ndarray, starts: np.ndarray, side: np.ndarray, radius: int, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many buckets, as places in ``fps``, shape (n, words). ``starts``: where each bucket begins there.

    ``side``: 0 and 1 for the two chunks of a tile, which are compared across
    only; 2 in a bucket that is compared with itself.
    """
    n = len(fps)
    label = np.arange(n)
    sizes = np.diff(np.append(starts, n))
    bucket = np.repeat(np.arange(len(starts)), sizes)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        real = (side[a] == 2) | (side[a] != side[b])
        _union(label, a[real], b[real])

    small = sizes[bucket] <= FEW
    for apart in range(1, FEW):
        a = np.nonzero(small[:-apart] & (bucket[apart:] == bucket[:-apart]))[0] if apart < n else np.zeros(0, np.int64)
        if not len(a):
            break
        a = a[np.bitwise_count(fps[a] ^ fps[a + apart]).sum(axis=1, dtype=np.int64) <= radius]
        join(a, a + apart)
    if small.all():
        linked = np.nonzero(label != np.arange(n))[0]
        return linked, label[linked]
    rows = np.nonzero(~small)[0]  # the rest in blocks of 64 lanes
    large = np.nonzero(sizes > FEW)[0]
    blocks_of = (sizes[large] + 63) // 64
    first = np.concatenate([[0], np.cumsum(blocks_of)[:-1]]).astype(np.int64)
    own = np.repeat(np.arange(len(large)), sizes[large])
    place = rows - starts[large][own]
    total = int(blocks_of.sum())
    laid, item = np.zeros((total, 64, fps.shape[1]), np.uint64), np.full((total, 64), -1, np.int64)
    block, lane = first[own] + place // 64, place % 64
    laid[block, lane], item[block, lane] = fps[rows], rows
    planes = np.concatenate([bit_planes(laid[k : k + BLOCKS]) for k in range(0, total, BLOCKS)], axis=1)
    later = blocks_of[own] - place // 64  # the item's own block and those after it
    ends = np.cumsum(later)
    at = 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + chunk, side="right")))
        take = np.arange(at, upto)
        many = later[take]
        who = np.repeat(take, many)
        which = block[who] + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        masks = within(planes, fps[rows[who]], which, radius)
        hit = masks != 0
        if hit.any():
            who, which = who[hit], which[hit]
            bits = np.unpackbits(masks[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane_of = np.nonzero(bits)
            a, b = rows[who[k]], item[which[k], lane_of]
            join(a[b > a], b[b > a])
        at = upto
    linked = np.nonzero(label != np.arange(n))[0]
    return linked, label[linked]


def _compare(radius: int, words: list[str], node: str):
    """mapInArrow over rows sorted by bucket; a bucket may lie over several batches."""
    keys = ["k1", "k2", "k3"]
    columns = [*keys, "side", node, *words]

    def solve(rows: list[np.ndarray]):
        order = np.lexsort([rows[4], *reversed(rows[:3])])
        *key, side, ids = (r[order] for r in rows[:5])
        fps = np.stack([r[order].view(np.uint64) for r in rows[5:]], axis=1)
        new = np.ones(len(ids), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        a, b = bucket_links(fps, np.nonzero(new)[0], side, radius)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["u", "v"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            changed = np.nonzero(np.any([k[1:] != k[:-1] for k in now[:3]], axis=0))[0]
            fresh = held and any(h[-1] != k[0] for h, k in zip(held[-1][:3], now[:3], strict=True))
            if fresh:
                yield solve([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            if len(changed):
                cut = int(changed[-1]) + 1
                yield solve([np.concatenate(c) for c in zip(*held, [x[:cut] for x in now], strict=True)])
                held, now = [], [x[cut:] for x in now]
            held.append(now)
        if held:
            yield solve([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _tiles(large: DataFrame, node: str, words: list[str], bucket: int) -> DataFrame:
    """Rows of buckets of ``n`` entries, more than ``bucket``, dealt to tiles in which every two chunks of a bucket meet."""
    chunks = F.least(F.ceil(F.col("n") / bucket), F.lit(MOST_CHUNKS)).cast("bigint")
    tiles = (
        large.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64(node), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        .withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other"))
    )
    side = F.when(F.col("a") == F.col("b"), 2).when(F.col("mine") == F.col("a"), 0).otherwise(1)
    # a tile's key: the bucket's, with the two chunks in the unused high bits of k3 and k1
    return tiles.select((F.col("k1") + F.shiftleft(F.col("a") + 1, 32)).alias("k1"), "k2", (F.col("k3") + F.shiftleft(F.col("b") + 1, 52)).alias("k3"), side.alias("side"), *dict.fromkeys([node, *words]))


def _compared(dealt: DataFrame, radius: int, words: list[str], node: str) -> DataFrame:
    rows = dealt.repartition(shuffle_partitions(dealt.sparkSession), "k1", "k2", "k3")
    return rows.sortWithinPartitions("k1", "k2", "k3").mapInArrow(_compare(radius, words, node), "u bigint, v bigint")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> ``(u, v)``, links whose closure is that of all links within ``radius``."""
    spark = distinct.sparkSession
    ship(spark)
    bands = radius + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]

    def piece(value, low: int, width: int):
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else value

    fp = F.col("fp")
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), piece(fp, edges[i], widths[i]).alias("value")) for i in range(bands))))
    first = distinct.select(fp, level.alias("b")).select("fp", "b.band", "b.value")
    # at most bands * 2**(64 / bands) keys whatever the number of rows, so this may be broadcast at radius 3 and above
    hot = checkpoint(first.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("band", "value"))
    as_key = lambda *c: [x.cast("bigint").alias(f"k{i + 1}") for i, x in enumerate(c)]
    zero = F.lit(0)
    if hot.isEmpty():
        dealt = first.select("fp", F.lit(2).alias("side"), *as_key(F.col("band"), F.col("value"), zero))
    else:
        hot = F.broadcast(hot) if radius >= 3 else hot
        cold = first.join(hot, ["band", "value"], "left_anti")
        dealt = cold.select("fp", F.lit(2).alias("side"), *as_key(F.col("band"), F.col("value"), zero))
        # the other bits, rotated to the low end, in radius + 1 bands again
        deeper = None
        for i in range(bands):
            left = 64 - widths[i]
            turn = edges[i + 1] % 64
            turned = F.shiftleft(fp, 64 - turn).bitwiseOR(F.shiftrightunsigned(fp, turn)) if turn else fp
            cuts = [left * j // bands for j in range(bands + 1)]
            subs = F.explode(F.array(*(F.struct(F.lit(j).alias("sub"), piece(turned, cuts[j], cuts[j + 1] - cuts[j]).alias("part")) for j in range(bands))))
            own = first.filter(F.col("band") == i).join(hot, ["band", "value"], "left_semi").select("fp", "band", "value", subs.alias("s")).select("fp", "band", "value", "s.sub", "s.part")
            deeper = own if deeper is None else deeper.union(own)
        deeper = checkpoint(deeper.select("fp", *as_key(F.col("band") * bands + F.col("sub") + bands, F.col("value"), F.col("part"))))
        keys = ["k1", "k2", "k3"]
        large = deeper.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
        sized = deeper.join(large, keys, "left")
        dealt = dealt.union(sized.filter("n IS NULL").select("fp", F.lit(2).alias("side"), *keys))
        dealt = dealt.select("k1", "k2", "k3", "side", "fp").union(_tiles(sized.filter("n IS NOT NULL"), "fp", ["fp"], bucket))
    return _compared(dealt, radius, ["fp"], "fp")


def radius_of(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts of this Jaccard similarity differ on average: the share is their angle by pi."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def wide_links(nodes: DataFrame, words: list[str], radius: int, bucket: int = BUCKET) -> DataFrame:
    """``nodes`` (``node`` and fingerprint ``words``) -> ``(u, v)``: links whose closure is that of all links within ``radius`` bits
    between fingerprints that agree on one of the keys, ``KEY_BITS`` neighbouring bits from every ``STRIDE``-th bit on."""
    ship(nodes.sparkSession)

    def key(start: int):
        k, off = divmod(start, 64)
        value = F.shiftrightunsigned(F.col(words[k]), off)
        if off + KEY_BITS > 64:
            value = value.bitwiseOR(F.shiftleft(F.col(words[k + 1]), 64 - off))
        return F.struct(F.lit(start).cast("bigint").alias("k1"), value.bitwiseAND(F.lit((1 << KEY_BITS) - 1).cast("bigint")).alias("k2"))

    starts = range(0, 64 * len(words) - KEY_BITS + 1, STRIDE)
    first = nodes.select("node", *words, F.explode(F.array(*map(key, starts))).alias("k")).select("k.k1", "k.k2", F.lit(0).cast("bigint").alias("k3"), F.lit(2).alias("side"), "node", *words)
    # at most 2**KEY_BITS keys for each start, whatever the number of rows
    hot = checkpoint(first.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket))
    n_hot = hot.count()
    if n_hot:
        sized = first.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, ["k1", "k2"], "left")
        cold = sized.filter("n IS NULL").select(*first.columns)
        first = cold.union(_tiles(sized.filter("n IS NOT NULL"), "node", words, bucket).select(*first.columns))
    return _compared(first, radius, words, "node")


def _classed(marked: DataFrame, id_col: str, radius: int, bucket: int) -> DataFrame:
    """``marked`` with ``root``, the smallest fingerprint of the row's class, and ``component_id``."""
    nodes = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("rep")))
    classes = checkpoint(connected_components(links(nodes.select("fp"), radius, bucket)).withColumnRenamed("node", "fp"))
    rooted = nodes.join(classes, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``(id_col, fp, component_id)``: one row for each row of ``df``.

    ``component_id`` is the smallest id among all rows whose fingerprints can be
    reached by links of at most ``radius`` differing bits; null ids take part
    but are never the smallest (a class without any id has a null component).
    Null, empty and wordless texts share fingerprint 0 and are linked like any
    other. Repeated rows stay and get the same class; other columns are not
    read; an empty table gives an empty result.
    """
    marked = checkpoint(fingerprints(df, id_col, text_col, size, seed))
    return _classed(marked, id_col, radius, bucket).select(id_col, "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = NEAR_SHINGLE, words: int = NEAR_WORDS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """One row of each class stays, that of the smallest id.

    Texts are linked whose fingerprints of ``words`` times 64 bits over shingles of
    ``size`` words differ in no more bits than texts of the given Jaccard
    ``similarity`` do on average, and agree on one of the keys of ``wide_links``.
    So similarity is estimated: of 256 bits, texts at 0.8 differ in 39, give or take 6.
    Equal texts are always linked. Texts of fewer words than a shingle are linked
    only if they are equal word by word.

    Null ids come last; of several texts under that id the one with the smallest
    hash stays, and of several rows with that text the smallest row. An id that
    is null or shared by unlike texts still keeps one row in every class. Null
    and wordless texts form one class; an empty table gives an empty result.
    """
    # the row's text is known by its 64-bit hash, which the Arrow pass hands on with the id
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = df.select(F.struct(F.col(id_col).alias("id"), text_key.alias("key")).alias("__row"), F.col(text_col))
    names = fp_columns(words)
    marked = fingerprints(keyed, "__row", text_col, size, seed, words)
    marked = checkpoint(marked.select(F.col("__row.id").alias("__id"), F.col("__row.key").alias("__key"), *names))
    # numbered while it is stored, and read with these numbers ever after
    nodes = checkpoint(marked.select(*names).distinct().withColumn("node", F.monotonically_increasing_id()))
    found = wide_links(nodes, names, radius_of(similarity, 64 * words), bucket) if words > 1 else links(nodes.select("fp"), radius_of(similarity, 64), bucket)
    if words == 1:
        nodes = nodes.withColumn("node", F.col("fp"))
    classes = checkpoint(connected_components(found))
    rooted = nodes.join(classes, "node", "left").select(*names, F.coalesce("component", "node").alias("root"))
    # copies collapse to one row a text before any join, so that many of them are no hot key
    texts = marked.groupBy("__key", *names).agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"))).alias("least"))
    best = texts.join(rooted, names).groupBy("root").agg(F.min(F.struct("least", "__key")).alias("b"))
    return _keep_one(df, marked, best.select(F.col("b.least.id").alias("__best_id"), F.col("b.__key").alias("__best_key")), id_col, text_col)


def _keep_one(df: DataFrame, marked: DataFrame, best: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that stay, without shuffling their texts where few go.

    ``marked`` has ``__id`` and ``__key``, the hash of the text, of every row; ``best``
    the id and hash of the one that stays of each class.
    """
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # a text lies in one class, so rows meet their class's choice by id and text, and a large class is no hot key
    chosen = best.withColumn("__best", F.lit(True))
    held = marked.groupBy("__id", "__key").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(chosen, F.col("__id").eqNullSafe(F.col("__best_id")) & (F.col("__key") == F.col("__best_key")), "left")
    # ids and texts that go, or stay once of several rows: all others are kept as they are
    odd = checkpoint(held.select("__id", "__key", F.col("__best").isNotNull().alias("__stays"), "n").filter("NOT __stays OR n > 1").drop("n"))
    counts = odd.agg(F.count(F.lit(1)), F.count_if("__stays")).first()
    odd = F.broadcast(odd) if counts[0] <= MOST_BROADCAST else odd
    rows = df.select(F.struct(*df.columns).alias("__whole"), F.col(id_col).alias("__own_id"), text_key.alias("__own_key"))
    judged = rows.join(odd, F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key")), "left")
    out = judged.filter("__stays IS NULL").select("__whole")
    if counts[1]:
        order = F.struct(*([F.col("__whole")[text_col]] + [F.col("__whole")[c] for c in df.columns if c not in (id_col, text_col)]))
        out = out.union(judged.filter("__stays").groupBy("__own_id", "__own_key").agg(F.min_by("__whole", order).alias("__whole")).select("__whole"))
    return out.select(*(F.col("__whole")[c].alias(c) for c in df.columns))
