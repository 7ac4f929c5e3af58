"""Whole licence texts, changed ones, and the intersection of postings against every start."""

from __future__ import annotations

import random
import re

from pageloom.llm import license


def starts(words: list[str]) -> list[tuple[str, int, float]]:
    """Every place by comparing every template with every start."""
    out = []
    for t in license.TEMPLATES:
        for at in range(-len(t.words) + 1, len(words)):
            same = [0 <= at + i < len(words) and words[at + i] == w for i, w in enumerate(t.words)]
            share = sum(same) / len(same)
            if share >= (1.0 if t.base else license.LEAST_SHARE) and all(all(same[a:b]) for a, b in t.mandatory):
                out.append((t.label, at, share))
    return sorted(out)


def test_whole_texts(spark):
    texts = [license.MIT, license.ISC, license.BSD, license.ZLIB, license.APACHE, license.GPL, license.MPL, license.UNLICENSE]
    df = spark.createDataFrame([(i, "Copyright 2020 A. Person\n\n" + t + "\nend") for i, t in enumerate(texts)], "doc_id int, text string")
    rows = license.licenses(df).orderBy("doc_id").collect()
    for r, t, label in zip(rows, texts, ("mit", "isc", "bsd", "zlib", "apache", "gpl", "mpl", "unlicense"), strict=True):
        whole = [p for p in r["places"] if p["n_words"] == len(license.template(label, t).words)]
        assert label in r["labels"].split(",") and r["score"] == 1 and [(p["label"], p["share"]) for p in whole] == [(label, 1.0)]


def test_intersection_loses_no_place(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = list(rng.choice(license.TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 1, 3, len(own) // 6])):
                own[rng.randrange(len(own))] = rng.choice(["other", "the", "license", "software", "public", "permission"])
            words += own[rng.choice([0, 0, 1]) :] + rng.choices(["license", "the", "software", "mit", "general", "public", "gnu"], k=rng.randint(0, 6))
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in license.licenses(df).collect():
        words = [w for w in re.split(license.SEPARATORS, texts[r["doc_id"]].lower()) if w]
        assert sorted((p["label"], p["start"], p["share"]) for p in r["places"]) == starts(words)


def test_one_rare_word_alone_posts_nothing():
    postings, need = license._postings(license.TEMPLATES)
    assert all(n >= 2 for n in need) and all(n <= license.ANCHORS for n in need)
    assert max(len(places) for places in postings.values()) < len(license.TEMPLATES)
