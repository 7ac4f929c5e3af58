"""The search stops before its lists are read, and is exact for components of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pageloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=topk.K):
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in whole if i % 50 == 0):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), topk.LEAST_SCORE), topk.MOST_SCORE), i) for i, v in whole.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def found(spark, rows):
    return sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("seed, dims, clusters", [(0, 8, 0), (1, 64, 0), (2, 64, 20), (3, 1, 0)])
def test_lists_are_left_early_and_nothing_is_lost(seed, dims, clusters):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3000, dims)) if not clusters else rng.normal(size=(clusters, dims))[rng.integers(0, clusters, 3000)] + 0.1 * rng.normal(size=(3000, dims))
    v = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)) if dims > 1 else np.floor(256 * x)
    ids, read = np.arange(3000), 0
    for q in range(0, 3000, 300):
        held: list = []
        for at, upto in topk.runs(3000):
            lists = topk.Lists(v[at:upto], ids[at:upto])
            best, entries = lists.best(v[q], q, 5, -held[4][0] if len(held) == 5 else -np.inf)
            read += entries
            held = sorted(held + best)[:5]
        s = (v @ v[q]).astype(np.int64)
        assert held == [(-int(s[j]), int(j)) for j in np.lexsort([ids, -s]) if j != q][:5]
    assert read < 0.95 * 10 * v.size


@pytest.mark.parametrize("size", [3e7, 1e18, 1e30, 3e38])
def test_large_components(spark, size):
    rng = np.random.default_rng(int(math.log10(size)))
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-size, size, 5)]) for i in range(120)] + [(200 + i, [1.0, -0.5, 0.25, 0.0, 3.0]) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [2.0, 5.0]), (7, [2.0, 5.0]), (7, [-1.0, 1.0])]
    # the smaller of the two vectors of id 50 asks; the rows of id 7 are candidates each
    assert found(spark, rows) == [(50, 1, 7, 5 * 65536), (50, 2, 7, 5 * 65536), (50, 3, 7, 65536)]
