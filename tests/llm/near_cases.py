"""Wide fingerprints and their classes, bit by bit."""

from __future__ import annotations

import math

import xxhash

MASK = 2**64 - 1


def mixed(h: int, k: int) -> int:
    if k == 0:
        return h
    z = (h + k * 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return z ^ (z >> 31)


def plain_wide(text: str | None, size: int = 5, words: int = 4) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), 42) for i in range(max(1, len(found) - size + 1))]
    out = 0
    for k in range(words):
        made = [mixed(h, k) for h in hashes]
        if len(found) < size:
            out |= made[0] << (64 * k)
            continue
        for bit in range(64):
            out |= (2 * sum(h >> bit & 1 for h in made) > len(made)) << (64 * k + bit)
    return out


def meet(a: int, b: int, bits: int = 256) -> bool:
    """Whether two fingerprints agree on one of the keys."""
    return any((a ^ b) >> start & 0xFFFF == 0 for start in range(0, bits - 15, 8))


def plain_near_classes(rows: list[tuple[int, str]], similarity: float = 0.8) -> set[int]:
    """The smallest id of each class."""
    radius = round(256 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    fps = [(i, plain_wide(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= radius and meet(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def jaccard(a: str, b: str, size: int = 5) -> float:
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])
