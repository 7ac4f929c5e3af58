"""Per-section token counts and packed ids, held against the libraries piece by piece."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pageloom.llm import bpe, packing

SCHEMA = "doc_id long, title string, text string"
TEXTS = ["one two  three\nfour\n\n five six\n", "", None, "\n", "a\r\nb\r\n\r\nc", "naïve 中文 😀\n😀😀 x", "x" * 300 + "\n" + "y" * 300, "tab\there\n\n\n   end", "don't\nwe'll  \n  go"]


def sections(enc, fields, rule):
    text = "\n".join(f or "" for f in fields)
    lines = text.split("\n")
    ends = np.cumsum([len((x + "\n").encode()) for x in lines])
    ends[-1] -= 1
    starts = np.concatenate([[0], ends[:-1]])
    counts, crossing, at = [0.0] * len(lines), [0] * len(lines), 0
    ids = enc.encode_ordinary(text)
    for i in ids:
        a, at = at, at + len(enc.decode_single_token_bytes(i))
        shares = {k: min(at, e) - max(a, s) for k, (s, e) in enumerate(zip(starts, ends, strict=True)) if min(at, e) > max(a, s)}
        if len(shares) > 1:
            for k in shares:
                crossing[k] += 1
        if rule == "first":
            counts[min(shares)] += 1
        elif rule == "most":
            counts[max(shares, key=lambda k: (shares[k], -k))] += 1
        else:
            for k, held in shares.items():
                counts[k] += held / (at - a)
    chars = np.cumsum([0] + [len(x) + 1 for x in lines])
    chars[-1] -= 1
    field = [f for f, x in enumerate(fields) for _ in (x or "").split("\n")]
    return [(k, field[k], int(chars[k]), int(chars[k + 1]), round(counts[k], 9), crossing[k], len(ids)) for k in range(len(lines))]


@pytest.mark.parametrize("rule", bpe.RULES)
def test_sections_by_every_rule(spark, corpus, rule):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "Title", "Two\nlines "]), t) for i, t in enumerate(TEXTS)]
    rows += [(100 + r["doc_id"], "T", r["text"]) for r in corpus.limit(40).collect()]
    with open(P.path(bpe.RANKS), "rb") as f:
        enc = bpe.encoding(f.read(), P.PATTERN)
    made = defaultdict(list)
    for r in bpe.token_counts(spark.createDataFrame(rows, SCHEMA), fields=("title", "text"), rule=rule).collect():
        made[r["doc_id"]].append((r["section"], r["field"], r["start"], r["end"], round(r["n_tokens"], 9), r["n_crossing"], r["doc_tokens"]))
    for i, title, text in rows:
        assert sorted(made[i]) == sections(enc, (title, text), rule)


def test_packed_pieces_hold_the_tokenizers_ids(spark, corpus):
    own = Tokenizer.from_file(P.path(packing.TOKENIZER))
    own.encode_special_tokens = True
    ids = {r["doc_id"]: own.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END_ID] for r in corpus.collect()}
    longest = max(ids, key=lambda i: len(ids[i]))
    assert len(ids[longest]) > packing.CAPACITY  # some documents have full pieces
    seen, full = defaultdict(int), 0
    used = defaultdict(list)
    for r in packing.packed(corpus).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        full += r["length"] == packing.CAPACITY
    assert full and seen == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        assert sum(n for _, n in parts) <= packing.CAPACITY
        assert sorted(parts) == [(sum(n for _, n in sorted(parts)[:k]), n) for k, (_, n) in enumerate(sorted(parts))]
    assert all(len(parts) == 1 for k, parts in used.items() if k < 0)
