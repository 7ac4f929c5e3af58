"""Near copies by wide fingerprints: planes and buckets against every pair, and changed texts by their similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest
from near_cases import jaccard, meet, plain_near_classes, plain_wide

from pageloom.llm import simhash

SCHEMA = "doc_id long, text string"


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("words, radius", [(1, 3), (1, 10), (2, 9), (4, 39), (4, 63), (4, 1), (3, 40)])
def test_planes_count_differing_bits(words, radius):
    rng = random.Random(radius)
    base = rng.getrandbits(64 * words)
    fps = [base ^ sum(1 << b for b in rng.sample(range(64 * words), rng.randint(0, min(64 * words, 2 * radius + 3)))) for _ in range(150)]
    table = np.array([[f >> (64 * k) & (2**64 - 1) for k in range(words)] for f in fps], np.uint64)
    laid = np.zeros((3, 64, words), np.uint64)
    laid.reshape(-1, words)[:150] = table
    who = np.repeat(np.arange(150), 3)
    masks = simhash.within(simhash.bit_planes(laid), table[who], np.tile(np.arange(3), 150), radius)
    for i, mask, block in zip(who, masks, np.tile(np.arange(3), 150), strict=True):
        for lane in range(min(64, 150 - 64 * block)):
            assert bool(int(mask) >> lane & 1) == ((fps[i] ^ fps[64 * block + lane]).bit_count() <= radius)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_links_are_those_of_every_pair(spark, bucket):
    rng = random.Random(bucket)
    fps = [rng.getrandbits(256) for _ in range(20)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(256), rng.randint(1, 60))) for f in fps for _ in range(6)]
    rows = [(n, *(signed(f >> (64 * k) & (2**64 - 1)) for k in range(4))) for n, f in enumerate(fps)]
    names = simhash.fp_columns(4)
    made = simhash.wide_links(spark.createDataFrame(rows, "node long, " + ", ".join(f"{n} long" for n in names)), names, 39, bucket=bucket).collect()

    def classes(edges):
        root = list(range(len(fps)))
        for a, b in edges:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        out = []
        for i in range(len(fps)):
            while root[i] != i:
                i = root[i]
            out.append(i)
        return out

    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 39 and meet(fps[i], fps[j])]
    assert classes([(r["u"], r["v"]) for r in made]) == classes(want) and all((fps[r["u"]] ^ fps[r["v"]]).bit_count() <= 3 * 39 for r in made)


def test_fingerprints(spark):
    texts = [None, "", " \t", "one", "one two three four", "a b c d e", "a b c d e f", "A  b\tc D e f", " ".join(f"w{i}" for i in range(900)), "é ß 中文 x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in simhash.fingerprints(df, size=5, words=4).collect():
        assert sum((r[f"fp{k}"] % 2**64) << (64 * k) for k in range(4)) == plain_wide(texts[r["doc_id"]])


def test_changed_texts_by_their_similarity(spark):
    rng = random.Random(5)
    rows, near, far = [], 0, 0
    for i in range(120):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * i, " ".join(words)))
        changed = list(words)
        for _ in range(rng.choice([1, 2, 3, len(words) // 60, len(words) // 8])):
            changed[rng.randrange(len(words))] = "changed"
        rows.append((10 * i + 1, " ".join(changed)))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == plain_near_classes(rows)
    text = dict(rows)
    for i in range(120):
        j = jaccard(text[10 * i], text[10 * i + 1])
        near += j >= 0.9
        far += j < 0.55
        assert 10 * i in kept and (j >= 0.55 or 10 * i + 1 in kept)
    caught = sum(jaccard(text[i - 1], text[i]) >= 0.9 and i not in kept for i in text if i % 10)
    assert near > 20 and far > 10 and caught >= 0.97 * near
