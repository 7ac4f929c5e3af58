"""Fences of the quality rules where a large part of a source is junk."""

from __future__ import annotations

import math

import pytest

from pageloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def clean(i: int, n: int = 40) -> str:
    return " ".join(f"w{i}x{k}" for k in range(n + i % 7))


def judged(spark, texts) -> dict:
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("junk, marks", [(90, 3), (90, 1), (135, 2), (210, 2)])
def test_much_junk_does_not_lift_the_fence(spark, junk, marks):
    texts = [" ".join(f"j{i}x{k}" + "%" * marks for k in range(40)) for i in range(junk)] + [clean(i) for i in range(300 - junk)]
    kept = judged(spark, texts)
    assert [i for i, k in kept.items() if k] == [i for i in kept if i >= junk]


def test_rows_that_fail_base_rules_make_no_fence(spark):
    odd = " ".join(f"v{k}" + "%" * (k % 2) for k in range(40))
    short = [f"s{i}%%%% t%%%%" for i in range(400)]
    kept = judged(spark, [odd, *short, *(clean(i) for i in range(250))])
    assert not kept[0] and not any(kept[i] for i in range(1, 401)) and all(kept[i] for i in range(401, 651))


def test_repetition_below_the_base_rule_is_judged(spark):
    # 5 words twice of 55: 18 % repeated, which the base rule of 20 % lets pass
    twice = " ".join(["a b c d e"] + [f"u{k}" for k in range(22)] + ["a b c d e"] + [f"v{k}" for k in range(23)])
    kept = judged(spark, [twice, *(clean(i) for i in range(250))])
    assert not kept[0] and sum(kept.values()) == 250


def test_fences_are_those_of_exact_quantiles_and_differ(spark, corpus):
    counted = quality.checkpoint(quality.base_counts(corpus).drop("text"))
    made = {(r["__q_lang"], r["__q_source"]): r.asDict() for r in quality.fences(quality.sketches(counted)).collect()}
    ratios = quality._ratios()
    rows = [r.asDict() for r in counted.select("lang", "source", "base_failed", *(c.alias(k) for k, c in ratios.items())).collect()]
    sound = [r for r in rows if not r["base_failed"] and not any(b and r[k] > b[1] for k, b in quality.RATIOS.items())]

    def parts(values):
        values = sorted(values) or [0.0]
        at = lambda q: values[max(0, math.ceil(q * len(values)) - 1)]
        low, middle, high = at(quality.OUTER), at(0.5), at(1 - quality.OUTER)
        return middle, middle - low, high - middle

    for key, row in made.items():
        own = [r for r in sound if (r["lang"], r["source"]) == key]
        weight = len(own) / (len(own) + quality.EVEN_WEIGHT)
        for k in ("word_length", "plain_odds", "line_length"):
            mine, whole = parts(r[k] for r in own), parts(r[k] for r in sound if r["lang"] == key[0])
            middle, *sides = (weight * a + (1 - weight) * b for a, b in zip(mine, whole, strict=True))
            for side, every, got, sign in zip(sides, whole[1:], (row[f"__q_low_{k}"], row[f"__q_high_{k}"]), (-1, 1), strict=True):
                least = quality.LEAST_SPREAD * abs(middle)
                reach = quality.SPREAD * max(min(side, quality.WIDEST * max(every, least)), least)
                # sf0.001 and sf0.01 have groups that a sketch holds whole; a language beyond that is exact up to the sketch's error of rank
                assert abs(got - (middle + sign * reach)) <= 0.1 * reach, (key, k)
    for k in ("word_length", "plain_odds", "line_length"):
        assert len({row[f"__q_high_{k}"] for row in made.values()}) > len(made) // 2
    by_bound = [r for r in rows if not r["base_failed"] and any(b and r[k] > b[0] for k, b in quality.RATIOS.items())]
    judged_out = quality.quality(corpus).filter("NOT kept AND NOT base_failed").count()
    assert judged_out > len(by_bound)  # fences reject rows that no bound does


def test_copies_in_a_source_narrow_no_fence(spark):
    rows = [(i, clean(5), "en", "s") for i in range(300)] + [(300 + i, clean(i), "en", "s") for i in range(300)]
    rows += [(600 + i, clean(i), "en", f"t{i % 3}") for i in range(600)]
    made = quality.quality(spark.createDataFrame(rows, SCHEMA)).filter("NOT kept").count()
    assert made == 0


def test_names_used_inside_may_be_input_columns(spark):
    rows = [(i, clean(i), "en", "s", 1, 2) for i in range(20)]
    odd = spark.createDataFrame(rows, SCHEMA + ", __q_lang int, __q_high_word_length int")
    assert quality.quality(odd).count() == 20
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == 20
    held = odd.withColumnRenamed("source", "__q_source")
    assert quality.keep_good(held, source_col="__q_source").count() == 20


def test_a_source_of_junk_alone_is_judged_by_its_language(spark):
    rows = [(i, clean(i), "en", "s") for i in range(250)] + [(1000 + i, " ".join(f"j{i}x{k}%%" for k in range(40)), "en", "junk") for i in range(50)]
    rows += [(2000, " ".join(f"j{k}%" for k in range(40)), "xx", "only junk"), (2001, clean(1), "yy", "only one"), (2002, None, "zz", None)]
    kept = {r["doc_id"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert kept == {*range(250), 2001}
