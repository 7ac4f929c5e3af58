"""Rule checks of chapters: nothing whose size follows the corpus goes through the driver."""

from __future__ import annotations

import pytest

from pageloom.operators import markup as M
from pageloom.plans import registry
from pageloom.sources import extension as X
from pageloom.sources import rules as U


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def chapters(spark):
    texts = ["<chapter><tgroup><row><para/></row></tgroup><imagedata/><xref linkend='page_1'/><link/></chapter>", "<chapter id='k'><title/><link linkend='k'/></chapter>", "<a", None, "<a/>"]
    return spark.createDataFrame(list(enumerate(texts)), "chapter int, xml string")


def test_errors_stay_inside_their_chapter(spark):
    df = chapters(spark)
    found, by_nodes = U.RuleValidator().errors(df), M.violations(M.node_table(df))
    assert "Join" not in plan(found) and "Exchange" not in plan(found) and "Join" not in plan(by_nodes)
    want = [("Broken Link", ""), ("Broken Link", "page_1"), ("Invalid Content Model", "chapter has no title"), ("Invalid Element", "row holds para"), ("Invalid Element", "tgroup holds row"), ("Missing Attribute", "imagedata lacks fileref"), ("Missing Attribute", "link lacks linkend"), ("Missing Attribute", "tgroup lacks cols")]
    assert sorted((r["chapter"], r["error_type"], r["error_description"]) for r in found.collect()) == [(0, *w) for w in want]
    assert sorted(found.collect()) == sorted(by_nodes.collect())


@pytest.mark.parametrize("name", ["udf_03_validator", "udf_07_transformer", "val_01_after_fixes"])
def test_chapters_are_not_broadcast(spark, small, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["udf_02_chain", "val_01_rules"])
def test_queries_join_no_nodes(spark, small, name):
    assert "Join" not in plan(registry.QUERIES[name](spark, small))


def test_error_counts_join_no_nodes(spark, small):
    assert "LeftAnti" not in plan(registry.QUERIES["snk_04_validation"](spark, small))


@pytest.mark.parametrize("name,passes", [("udf_03_validator", 1), ("udf_07_transformer", 3)])
def test_verdicts_join_no_errors(spark, small, name, passes):
    found = plan(registry.QUERIES[name](spark, small)).partition("Initial Plan")[0]
    assert "Join" not in found and found.count("MapInArrow") == passes


def test_verdicts_are_those_of_the_joined_errors(spark):
    df = chapters(spark)
    rows = sorted(U.RuleValidator().validate(df).collect(), key=lambda r: r["chapter"])
    assert rows == sorted(X.Validator.validate(U.RuleValidator(), df).collect(), key=lambda r: r["chapter"])
    assert [(r["is_valid"], r["n_errors"]) for r in rows] == [(False, 8)] + [(True, 0)] * 4


def test_equal_texts_of_a_batch_are_worked_on_once(spark):
    texts = ["<a/>", None, "<b><c/></b>", "<a/>", None, "", "<b><c/></b>"] * 3
    calls = spark.sparkContext.accumulator(0)

    def work(x):
        calls.add(1)
        return x, x and [{"fix": x, "kind": None, "detail": "d"}]

    df = spark.createDataFrame(list(enumerate(texts)), "chapter int, xml string").coalesce(1)
    rows = M._row_by_row(df, "chapter", "xml", [("same", M.pa.string(), "string"), ("fixes", M._LOG, "array<struct<fix:string,kind:string,detail:string>>")], work).collect()
    assert sorted((r["chapter"], r["same"]) for r in rows) == list(enumerate(texts))
    assert all((r["fixes"][0]["fix"] if r["fixes"] else None) == (r["same"] or None) for r in rows) and calls.value == 4
