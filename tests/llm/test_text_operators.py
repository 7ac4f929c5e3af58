"""Token counts, byte-level BPE, licence scans, personal data and quality rules against brute force."""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import PHRASES, TEXTS, base_licenses, base_spans, quality_counts
from pyspark.sql import functions as F

from pageloom.llm import bpe, license, pii, quality

RANKS = open(P.path(bpe.RANKS), "rb").read()
REFERENCE = tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})


def by_row(df, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in columns)) for r in df.collect()), key=str)


def expected(make):
    return sorted(((i is None, i or 0, *make(t)) for i, t in TEXTS), key=str)


def test_bpe_is_the_library_and_round_trips(docs, corpus):
    for df in (docs, corpus):
        texts = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in df.select("doc_id", "text").collect()), key=str)
        made = sorted(((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["decoded"]).decode(), list(r["ids"])) for r in bpe.encode_decode(df).collect()), key=lambda x: str(x[:3]))
        assert [m[:3] for m in made] == texts
        assert all(m[3] == REFERENCE.encode_ordinary(m[2]) for m in made)


def test_long_texts_are_cut_only_where_it_is_safe():
    rng = random.Random(3)
    enc = bpe.encoding(RANKS, P.PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "'s", "'", "12", "é", "中", "😀", " ", "\x1f", "!!", "\t"]) for _ in range(200))
        assert bpe.encode(enc, text, long=5).tolist() == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("rule", bpe.RULES)
def test_tokens_are_allotted_once(docs, rule):
    out = bpe.token_counts(docs.filter("doc_id IS NOT NULL"), rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("doc_tokens").alias("m"), F.count("*").alias("k")).collect()
    rows = {r["doc_id"]: r for r in out}
    repeats = {2: 2}
    for i, t in TEXTS:
        if i is not None:
            times = repeats.get(i, 1)
            assert abs(rows[i]["n"] - times * len(REFERENCE.encode_ordinary(t or ""))) < 1e-6
            assert rows[i]["k"] == times * ((t or "").count("\n") + 1)


def test_allotting_rules():
    starts, ends, bounds = np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 4, 4, 8, 9])
    assert bpe.attribute(starts, ends, bounds, "first").tolist() == [2, 0, 1, 0]
    assert bpe.attribute(starts, ends, bounds, "most").tolist() == [2, 0, 1, 0]
    assert np.allclose(bpe.attribute(starts, ends, bounds, "share"), [1.5, 0, 1.25, 0.25])
    with pytest.raises(ValueError):
        bpe.token_counts(None, rule="other")


def test_several_fields(spark):
    df = spark.createDataFrame([(1, "a title", "body one\nbody two"), (2, None, None)], "doc_id long, title string, body string")
    rows = sorted((r["doc_id"], r["section"], r["field"], r["start"], r["end"]) for r in bpe.token_counts(df, fields=("title", "body")).collect())
    assert rows == [(1, 0, 0, 0, 8), (1, 1, 1, 8, 17), (1, 2, 1, 17, 25), (2, 0, 0, 0, 1), (2, 1, 1, 1, 1)]


def test_licences(docs, corpus):
    for df in (docs, corpus):
        made = license.licenses(df.select("doc_id", "text")).select("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
        for r in made:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_licenses(r["text"])
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
            assert r["n_base"] == 0 or r["score"] == 1


def test_licence_templates(spark):
    texts = [
        "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Licensed under CC BY-NC 4.0.", "a GNU Lesser General Public License", "the mit\tLICENSE mit license", "limit license", "license mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in license.licenses(df).orderBy("doc_id").collect()] == ["mit", "cc-by-nc", "gpl,lgpl", "mit", "", "", "bsd"]
    assert {label for _, label in PHRASES} == {t.label for t in license.TEMPLATES if t.base}


def test_base_spans(docs, corpus):
    for df in (docs, corpus):
        for r in pii.spans(df.select("doc_id", "text")).collect():
            assert [(s["start"], s["end"], s["kind"]) for s in r["pii"] if s["base"]] == base_spans(r["text"])


def test_added_spans_and_redaction(spark):
    df = spark.createDataFrame([(1, "call me at (415) 555-1234, ssn: 123-45-6789, iban DE89370400440532013000, é joe [at] mail [dot] org; order 123-45-6789"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert rows[1].startswith("call me at [LOCAL_PHONE], ssn: [SSN], iban [IBAN], é [AT_DOT_EMAIL]; order ") and rows[2] is None and rows[3] == ""


def test_trees_separate_held_out_texts(spark):
    trees, limits = pii.model(spark)
    held = pii.training_texts(1500, seed=99)
    df = spark.createDataFrame([(t, y) for t, y in held], "text string, y int")
    made = [(any(True for _ in r["pii"]), r["y"]) for r in pii.spans(df).collect()]
    right = sum(bool(y) for found, y in made if found)
    assert right / sum(found for found, _ in made) > 0.9 and right / sum(y for _, y in made) > 0.6 and len(limits) == len(pii.KINDS)


def test_quality_counts(docs, corpus):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (docs, corpus):
        for r in quality.base_counts(df).collect():
            want = quality_counts(r["text"])
            assert tuple(r[n] for n in names) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_keeps_the_clean(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    made = quality.quality(corpus).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in made}
    assert share[1] > 0.97
    assert all(not r["kept"] for r in quality.quality(corpus).filter("base_failed").collect())


def test_quality_fences_follow_their_group(spark):
    rows = [(i, " ".join(f"w{i}x{k}" + ("%" if src == "math" and k % 2 else "") for k in range(40 + i % 7)), "en", src) for src in ("math", "news") for i in range(300)]
    rows.append((1000, " ".join(f"v{k}%" if k % 2 else f"v{k}" for k in range(40)), "en", "news"))
    made = {(r["doc_id"], r["source"]): r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(made[(i, "math")] for i in range(300)) and all(made[(i, "news")] for i in range(300)) and not made[(1000, "news")]


def test_keep_good_leaves_rows_as_they_are(docs):
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {i for i, _ in TEXTS}
    assert out.filter("doc_id = 2").count() == 2


def test_empty_tables(empty):
    for made in (bpe.encode_decode(empty), bpe.token_counts(empty), license.licenses(empty), pii.spans(empty), pii.redact(empty), quality.quality(empty), quality.keep_good(empty)):
        assert made.count() == 0
