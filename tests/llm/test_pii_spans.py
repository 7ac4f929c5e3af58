"""Spans that the method adds to the base ones: texts written apart from the training templates, and the driver's planted secrets."""

from __future__ import annotations

import re

import numpy as np
import pytest

from pageloom.llm import pii, registry

PERSONAL = [
    ("export GITHUB_TOKEN='ghp16C7e42F292c6912E7710c838347Ae178B4a' now", "ghp16C7e42F292c6912E7710c838347Ae178B4a"),
    ("the db password: 9f86d081884c7d659a2feaa0c55ad015 leaked", "9f86d081884c7d659a2feaa0c55ad015"),
    ("please write to jane.roe[at]example[dot]com today", "jane.roe[at]example[dot]com"),
    ("contact jane (at) example (dot) org", "jane (at) example (dot) org"),
    ("my phone is (415) 555-0132, ring after six", "(415) 555-0132"),
    ("Maria, born 12.03.1984 in Ulm", "12.03.1984"),
    ("she lives at 742 Evergreen Lane with him", "742 Evergreen Lane"),
    ("iban GB82 WEST 1234 5698 7654 32 of the bank", "GB82 WEST 1234 5698 7654 32"),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 answers", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
]
CLEAN = [
    "see commit 9f86d081884c7d659a2feaa0c55ad0154f1bdc1e for details", "at 12:30:45 the train left", "the ratio 3:4 held in 2019-04-01 releases published 2019-04-02",
    "order 123-45-6789 was sent", "chapter 12 The Long Road ends here", "we met at noon. Then it rained", "a state-of-the-art-well-known-thing in 1999", "item 555-123-4567 is sold out",
]


def found(spark, texts) -> list[set]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [{t[s["start"] : s["end"]] for s in r["pii"]} for t, r in zip(texts, pii.spans(df).orderBy("doc_id").collect(), strict=True)]


def test_texts_of_other_hands(spark):
    got = found(spark, [t for t, _ in PERSONAL])
    assert [want in seen for seen, (_, want) in zip(got, PERSONAL, strict=True)] == [True] * len(PERSONAL)
    assert found(spark, CLEAN) == [set()] * len(CLEAN)


def test_planted_secrets_of_the_driver(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = {r["doc_id"]: r for r in registry.op6_pii(spark, "/root/testdata/sf0.01").collect()}
    planted, caught = 0, 0
    for r in df.select("doc_id", "text").collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"] or ""):
            planted += 1
            caught += f"secret:{m.start(1)}:{m.end(1)}" in made[r["doc_id"]]["spans"].split(",")
    assert planted > 5 and caught >= 0.9 * planted
    added = sum(r["n_spans"] - r["n_email"] - r["n_ip"] - r["n_card"] - r["n_phone"] for r in made.values())
    assert caught <= added <= 1.2 * planted


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_regression(seed):
    rng = np.random.default_rng(seed)
    score, label = rng.integers(0, 12, 200) / 4, rng.integers(0, 2, 200)
    values, p = pii.calibrated(score, label)
    assert list(values) == sorted(set(score)) and (np.diff(p) >= 0).all()
    weight = np.array([(score == v).sum() for v in values])
    mean = np.array([label[score == v].mean() for v in values])
    # min-max formula of isotonic regression
    for i in range(len(values)):
        best = max(min((mean[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum() for b in range(i, len(values))) for a in range(i + 1))
        assert abs(p[i] - best) < 1e-9
