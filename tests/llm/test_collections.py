"""Sharding, near-duplicates, top-k search, packing and the pipeline against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from near_cases import plain_near_classes
from cases import TEXTS, lowered, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm import packing, pii, quality, sharding, simhash, topk
from pageloom.llm.common import checkpoint


# ---- sharding ----
def test_shards(docs, corpus, tmp_path):
    for n, df in enumerate((docs, corpus)):
        rows = sharding.shard(df, str(tmp_path / f"maps{n}")).collect()
        assert len(rows) == df.count()
        texts = defaultdict(list)
        for i, t in df.select("doc_id", "text").collect():
            texts[i].append((t or "").encode())
        sizes, places = defaultdict(int), defaultdict(list)
        for r in rows:
            assert any(r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) for t in texts[r["doc_id"]])
            sizes[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(8))
        if n:
            assert max(sizes.values()) - min(sizes.values()) < 200


def test_slot_maps(spark, tmp_path):
    rng = np.random.default_rng(1)
    weights = [int(w) for w in rng.integers(1, 1000, 512)]
    first = sharding.SlotMap.initial(512, 8)
    second = first.rebalanced(weights)
    load = np.bincount(second.owner, weights=weights, minlength=8)
    assert second.version == 1 and load.max() - load.min() <= 2
    assert sum(a != b for a, b in zip(first.owner, second.owner, strict=True)) < 120
    heavier = [w * (3 if s == 0 else 1) for s, w in zip(second.owner, weights, strict=True)]
    assert sum(a != b for a, b in zip(second.owner, second.rebalanced(heavier).owner, strict=True)) < 200
    grown = second.grown(weights)
    load = np.bincount(grown.owner, weights=weights, minlength=9)
    assert len(load) == 9 and load.max() - load.min() <= 2
    second.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 1) == second
    assert sharding.SlotMap.initial(16, 4).rebalanced([0] * 16).owner == sharding.SlotMap.initial(16, 4).owner


def test_no_documents_to_shard(empty, tmp_path):
    assert sharding.shard(empty, str(tmp_path / "maps")).count() == 0


# ---- near-duplicates ----
def plain_fingerprint(text) -> int:
    w = words(lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_classes(rows, radius=3) -> list:
    fps = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)[0]:
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def test_fingerprints(docs, corpus):
    for df in (docs, corpus.limit(60)):
        texts = df.select("doc_id", "text").collect()
        made = simhash.fingerprints(df).collect()
        assert sorted(((r[0] is None, r[0] or 0, r[1] % 2**64) for r in made)) == sorted(((i is None, i or 0, plain_fingerprint(t)) for i, t in texts))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_classes(docs, corpus, bucket):
    for df in (docs, corpus):
        made = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df, bucket=bucket).collect()]
        assert len(made) == df.count()
        assert [m[2] for m in made] == plain_classes([m[:2] for m in made])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6])
def test_links_of_planted_fingerprints(spark, radius):
    rng = np.random.default_rng(radius)
    fps = set(int(x) for x in rng.integers(0, 2**63, 60))
    for f in list(fps):
        for _ in range(4):
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                f ^= 1 << int(b)
                fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, bucket=3).collect()
    root = {s: s for s in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        assert bin((e["u"] ^ e["v"]) % 2**64).count("1") <= 64
        a, b = find(e["u"]), find(e["v"])
        root[max(a, b)] = min(a, b)
    place = {s: k for k, s in enumerate(signed)}
    want = plain_classes([(k, f) for k, f in enumerate(fps)], radius)
    groups = defaultdict(set)
    for s in signed:
        groups[find(s)].add(place[s])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k, w in enumerate(want) if w == c) for c in set(want))


def test_one_of_each_class_stays(docs, empty):
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 4 in ids and 5 not in ids
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_unlike_texts_under_one_id_stay(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red orange yellow green blue indigo")
    rows = [(None, a, 1), (None, b, 2), (None, b, 1), (7, c, 1), (7, a + " zeta eta theta", 3), (9, c, 0), (7, c, 1)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    want = [(None, a, 1), (None, b, 1), (7, c, 1), (7, a + " zeta eta theta", 3)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


# ---- top-k ----
def plain_top(rows, k=5):
    held = [(i, np.floor(np.float64(256) * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in held), default=0)
    held = [(i, np.pad(v, (0, width - len(v)))) for i, v in held]
    out = []
    for q, v in {i: v for i, v in reversed(held)}.items():
        if q % 50 == 0:
            best = sorted(((-int(v @ w), i) for i, w in held if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=16).round(1)]) for i in range(400)]
    rows += [(i, [1.0] * 16) for i in range(400, 460)] + [(600, None), (650, [float("nan")] * 16), (700, [None] + [1.0] * 15), (None, [1.0] * 16), (750, []), (800, [2.0, -3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for blocks in ((8192, 16384, 4096), (3, 64, 32)):
        for name, value in zip(("QUERY_BLOCK", "CANDIDATE_BLOCK", "LIST_ROWS"), blocks, strict=True):
            monkeypatch.setattr(topk, name, value)
        assert sorted(tuple(r) for r in topk.top_k(df).collect()) == plain_top(as_float)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(50, [1.0]), (3, [-1.0])], schema)).collect()] == [(50, 1, 3, -65536)]


# ---- packing ----
def checked(rows, docs, capacity=packing.CAPACITY):
    """Every id of every document once, gapless sequences; returns the share of padding."""
    fill, cut = defaultdict(list), defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        cut[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= capacity
    for (_, total), parts in cut.items():
        assert sum(n for _, n in parts) % total == 0
    return 1 - sum(n for p in fill.values() for _, n in p) / (capacity * len(fill)) if fill else 0


def test_pieces_are_the_tokenizers_ids(docs, corpus):
    own = Tokenizer.from_file(P.path(packing.TOKENIZER))
    own.encode_special_tokens = True
    for df in (docs, corpus):
        whole = defaultdict(list)
        for i, t in df.select("doc_id", "text").collect():
            whole[i].append(own.encode(t or "", add_special_tokens=False).ids + [2])
        for r in packing.pieces(df).collect():
            got = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(got) == r["length"]
            assert any(ids[r["start"] : r["start"] + r["length"]] == got and len(ids) == r["doc_tokens"] for ids in whole[r["doc_id"]])


def test_words_outside_the_usual_alphabets():
    own = Tokenizer.from_file(P.path(packing.TOKENIZER))
    own.encode_special_tokens = True
    enc = packing.WordEncoder(open(P.path(packing.TOKENIZER), encoding="utf-8").read())
    rng = np.random.default_rng(5)
    alphabet = list("ab'sTt re ve,.\t\n\x0b\x1c\x85\xa0\xadéÉİßŉſ²½9 0Σσẞ中😀́<|endoftext|>%%%")
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_the_memory_of_words_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    enc = packing.WordEncoder(open(P.path(packing.TOKENIZER), encoding="utf-8").read())
    text = "one two three four five six one two seven one"
    assert enc.encode(text) == enc.encode(text) and len(enc) <= 3


def test_packing(docs, corpus, empty):
    assert checked(packing.packed(docs).collect(), docs) < 0.5
    assert checked(packing.packed(corpus).collect(), corpus) < 0.08
    assert packing.packed(empty).count() == 0


def test_little_padding_on_many_lengths(spark):
    lengths = np.random.default_rng(2).gamma(1.2, 500, 20000).astype(int).clip(1, 4096)
    cut = checkpoint(spark.createDataFrame([(i, 0, int(n), int(n)) for i, n in enumerate(lengths)], "doc_id long, start long, length long, doc_tokens long"))
    assert checked(packing.pack(cut).collect(), None) < 0.02


def test_cutting_stock():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 64, rng.integers(1, 30)))
        demand = rng.integers(1, 200, len(sizes))
        plan = packing.cutting_stock(sizes, demand, 64)
        assert (sum(p * n for p, n in plan) == demand).all() and all((p * sizes).sum() <= 64 for p, _ in plan)
        assert sum(n for _, n in plan) <= 1.12 * (sizes * demand).sum() / 64 + len(sizes) + 1 or sizes.max() > 32
    assert packing.cutting_stock(np.array([], int), np.array([], int), 64) == []


# ---- pipeline ----
def test_pipeline(spark, corpus):
    sf = "/root/testdata/sf0.001"
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf))
        assert docs.columns == corpus.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.quality(corpus).filter("kept").collect()}
    assert set(seen["quality"]) == kept
    assert set(seen["simhash"]) == plain_near_classes(sorted(seen["quality"].items()))
    spans = {r["doc_id"]: r["pii"] for r in pii.spans(corpus).collect()}
    for i, t in seen["pii"].items():
        assert (t == seen["simhash"][i]) == (len(spans[i]) == 0)
    made = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in made} == set(seen["pii"])
    own = Tokenizer.from_file(P.path(packing.TOKENIZER))
    for r in made:
        assert r["doc_tokens"] == len(own.encode(seen["pii"][r["doc_id"]], add_special_tokens=False).ids) + 1


def test_pipeline_stages_on_odd_rows(spark, docs, empty):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = plain.collect()
    assert len(TEXTS) == len(rows) and sum(r["text"] is None for r in rows) == 2
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, plain, "").collect()
    assert all(r in rows for r in good) and not any((r["text"] or "").split() == [] for r in good) and sum(r["doc_id"] == 2 for r in good) == 2
    single = stages["simhash"](spark, plain, "").collect()
    assert all(r in rows for r in single) and len(set(single)) == len(single)
    texts = Counter((r["text"] or "").strip() for r in single)
    assert texts[""] == 1 and max(texts.values()) == 1 and {t.strip() for _, t in TEXTS if t} >= set(texts)
    clean = stages["pii"](spark, plain, "").collect()
    assert len(clean) == len(rows) and sum(r["text"] is None for r in clean) == 2 and all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)
    pieces = stages["packing"](spark, plain, "").collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in rows)
    for df in (plain.limit(0), empty.select(plain.columns)):
        assert all(stage(spark, df, "").count() == 0 for stage in stages.values())
