"""Sequential operators on cases worked out by hand."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from pageloom.functions import word_splits
from pageloom.operators import kernels as K


def test_three_anchors_differ():
    values = [0.0, 4.0, 8.0, 12.0]
    assert K.running_mean_groups(values, 5) == [1, 1, 2, 2]
    assert K.anchored_groups(values, 5) == [1, 1, 2, 2]
    assert K.running_mean_groups([0.0, 4.0, 7.0, 9.0], 5) == [1, 1, 1, 2]
    assert K.anchored_groups([0.0, 4.0, 7.0, 9.0], 5) == [1, 1, 2, 2]
    assert K.running_mean_groups([], 5) == [] == K.anchored_groups([], 5)


def test_column_count_and_bins():
    assert K.column_count([0, 1], 400) == 1 and K.column_count([0, 1, 200, 201, 390], 400) == 2
    assert K.online_bins([0, 10, 100, 20, 90], [1, 1, 1, 1, 1], 25) == [1, 1, 2, 1, 2]


@pytest.mark.parametrize("gaps, width, want", [
    ([], 50, 40.0), ([5, 5, 5, 5], 50, 30.0), ([2, 3, 50, 60, 70], 50, 26.5), ([100, 120], 50, 70.0), ([2, 3, 4, 5, 9], 50, 20.0), ([20] * 8, 150, 14.0),
])
def test_gap_threshold(gaps, width, want):
    assert K.gap_threshold(gaps, width, 400) == pytest.approx(want)


def test_columns():
    rows = [(20.0 * k, x, 120.0) for k in range(10) for x in (20.0, 220.0)]
    assert K.column_starts(rows, 400) == [20.0, 220.0]
    assert K.column_starts([], 400) == [] and K.column_starts([(0.0, 7.0, 5.0)], 400) == [7.0]
    assert [K.column_id(x, w, 400, [20.0, 220.0]) for x, w in ((20, 120), (220, 120), (5, 390), (150, 100))] == [1, 2, 0, 0]
    assert K.column_id(99, 5, 400, [1.0]) == 1


def test_reading_blocks():
    assert K.reading_blocks([0, 1, 1, 2, 2, 3], [0, 1, 2, 1, 2, 0]) == [1, 2, 3, 2, 3, 4]
    assert K.reading_blocks([0, 1, 2], [1, 1, 1]) == [1, 1, 1]
    assert K.reading_blocks([0, 0, 1, 1, 1], [1, 2, 1, 2, 0]) == [1, 2, 1, 2, 3]
    assert K.reading_blocks([], []) == []


def test_inline_runs():
    of = lambda *rows: K.inline_runs([(t, left, w, 10.0) for t, left, w in rows], {"the"})
    assert of(("word", 0, 20), (".", 30, 2)) == [1, 1] and of(("word", 0, 20), (".", 30.1, 2)) == [1, 2]
    assert of(("•", 0, 4), ("item", 24, 20)) == [1, 1] and of(("•", 0, 4), ("item", 24.1, 20)) == [1, 2]
    assert of(("in the", 0, 20), ("house", 34, 20)) == [1, 1] and of(("near", 0, 20), ("house", 34, 20)) == [1, 2]


def test_repairs_and_lists():
    assert K.repair_columns([1, 2, 1, 0, 1], [0, 10, 20, 30, 40], 5) == [1, 1, 1, 0, 1]
    assert K.repair_columns([1, 0, 1], [0, 1, 2], 5) == [1, 1, 1]
    assert K.list_levels([0, 2, 6, 0], [1, 1, 2, 2]) == [0, 1, 2, 0]
    assert K.table_chains([(1, 3, False), (2, 3, False), (3, 3, False)]) == [False, True, False]
    assert K.table_chains([(1, 3, False), (5, 2, True)]) == [False, True]


def test_aligned_tables():
    assert K.aligned_tables([(0, 10, [0, 50]), (12, 10, [3, 60]), (60, 10, [0, 50]), (61, 10, [0])]) == [1, 1, 0, 0]


def test_rectangles():
    assert K.merged_rects([(0, 0, 10, 10), (25, 0, 30, 10), (100, 100, 110, 110)]) == [0, 0, 2]
    assert K.covered_rects([(0, 0, 10, 10), (0, 0, 10, 8), (50, 50, 60, 60)]) == [0, 0, 2]
    assert K.components(5, [(0, 1), (3, 4), (1, 2)]) == [0, 0, 0, 3, 3]


def row(**kw):
    return {"page": 0, "col_id": 1, "block": 1, "top": 0.0, "height": 10.0, "left": 0.0, "width": 100.0, "font_size": 10.0, "bold": False, "text": "words", **kw}


@pytest.mark.parametrize("second, joined", [
    ({"top": 11.0}, True), ({"top": 11.0, "page": 1}, False), ({"top": 11.0, "bold": True}, False), ({"top": 11.0, "font_size": 12.0}, False), ({"top": 40.0}, False), ({"top": 21.0}, False),
    ({"top": 19.0}, True), ({"top": 11.0, "col_id": 2}, True),
])
def test_paragraph_rules(second, joined):
    assert (len(set(K.paragraph_groups([row(), row(**second)]))) == 1) == joined


def test_paragraphs_pass_the_block_on():
    rows = [row(text="one two"), row(top=11.0, col_id=2, block=2, text="three"), row(top=22.0, col_id=2, block=1, text="four.")]
    assert K.paragraph_groups(rows) == [1, 1, 1]
    assert K.paragraph_groups([row(text="man-"), row(top=40.0, text="agement")]) == [1, 1]


def test_labels():
    base = {"kind": "line", "heading": None, "text": "x", "font_size": 10.0, "is_noise": False, "is_list": False, "in_outline": True}
    rows = [
        {**base, "heading": "book_title", "font_size": 30.0}, {**base, "heading": "toc", "font_size": 16.0}, {**base, "text": "One .. 1"}, {**base, "heading": "chapter", "font_size": 18.0}, base, {**base, "is_list": True},
        {**base, "kind": "table"}, {**base, "is_noise": True}, {**base, "heading": "index", "font_size": 18.0}, {**base, "text": "A", "is_noise": True}, {**base, "text": "apple, 3"}, {**base, "heading": "chapter", "font_size": 18.0, "in_outline": False},
    ]
    assert K.block_labels(rows) == ["book_title", "toc", "toc_item", "chapter", "para", "list_item", "table", "", "section", "index_letter", "index_entry", "section"]


@pytest.mark.parametrize("text, want", [
    (None, None), ("", ""), ("man- agement", "management"), ("elec-tromagnetic", "electromagnetic"), ("high-quality", "high-quality"), ("Com pany.", "Company."), ("weal th", "wealth"), ("plain", "plain"),
])
def test_word_splits(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(word_splits.repair(F.col("t"))).first()[0] == want


def test_groups_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(g, None if g == 2 else g % 3, i, float(i * 2 % 7)) for g in range(6) for i in range(1 + g * 4)]
    df = spark.createDataFrame(rows, "a int, b int, i int, v double")
    made = K.per_group(df, ["a", "b"], ["i"], "n", "int", lambda p: [len(p)] * len(p)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["a"], r["i"], r["n"]) for r in made) == sorted((g, i, 1 + g * 4) for g, _, i, _ in rows)
    assert K.per_group(df.limit(0), ["a"], ["i"], "n", "int", lambda p: []).count() == 0


@pytest.mark.parametrize("text, want", [
    (None, None), ("", ""), ("plain", "plain"), ("a\t\tb", "a\t\tb"), ("line one\n\nLine two", "line oneLine two"), ("exam-\nple", "exam-ple"), ("the cat\nsat", "the cat sat"),
    ("man- agement of", "management of"), ("well-known re-ally", "well-known re-ally"), ("foo-bar-ing", "foo-bar-ing"), ("lat-ing-tion", "lating-tion"),
    ("Com pany. The na tion ity", "Company. Thena tionity"), ("Se nior na tion ally", "Senior nationally"), ("a tion, b tion", "ation, btion"), ("Éta ti!", "Étati!"), ("of  fice", "office"), ("x \\ y", "x \\ y"),
])
def test_word_split_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(word_splits.repair(F.col("t"))).first()[0] == want
