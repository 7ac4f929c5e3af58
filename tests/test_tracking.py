"""Tracking operators on empty tables, nulls and odd spellings; sources, sinks and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.functions import strings as S
from pageloom.operators import tracking as T
from pageloom.operators import windows as N
from pageloom.plans import registry
from pageloom.sources import extension as X
from pageloom.sources import readers as R
from pageloom.sources import writers as K

SCHEMA = "job_id string, job_key long, status string, created_at timestamp, publisher string, conversion_type string, num_pages long, num_tables long, num_raster_images long, num_chapters long, duration_seconds long"


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tuple(T.totals(empty).first()) == (0, 0, 0, 0, 0, 0.0)
    assert T.count_by(empty, "status").count() == 0 and T.daily(empty).count() == 0 and T.publishers(empty).count() == 0
    assert T.dashboard(empty, F.current_timestamp()).first()["total"] == 0


def test_odd_rows(spark):
    rows = [("1", 1, "Completed", None, None, None, 5, 1, 0, 1, None), ("2", 2, "Partial Success", None, "", "pdf", None, None, None, None, 10), ("3", 3, "mystery", None, "P", "pdf", 2, 0, 0, 0, 5), ("4", 4, None, None, None, "pdf", 1, 0, 0, 0, 0)]
    df = T.normalise(spark.createDataFrame(rows, SCHEMA))
    assert [r["status"] for r in df.orderBy("job_key").collect()] == ["success", "partial", "mystery", None]
    assert T.totals(df).first()["avg_duration"] == 5.0
    assert {r["publisher"]: r["total"] for r in T.publishers(df).collect()} == {None: 2, "P": 1}
    assert {r["publisher"] for r in T.publishers(df, exclude_null=True).collect()} == {"P"}
    assert {r["status"]: r["n"] for r in T.count_by(df, "status").collect()} == {"success": 1, "partial": 1, "mystery": 1, None: 1}


@pytest.mark.parametrize("text, want", [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("garbage", None), (None, None)])
def test_times(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.parse_time(F.col("t")).cast("string").alias("x")).first()["x"] == want


def test_routes(spark):
    pages = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1)], "page_num int, table_count int, image_count int").withColumns({"column_count": F.lit(1), "drawing_count": F.lit(6)})
    routed = T.route_pages(T.page_complexity(pages), [1, 3], [3, 9])
    assert [r["route_to_ai"] for r in routed.orderBy("page_num").collect()] == [True, True, False]
    assert [r["level"] for r in routed.orderBy("page_num").collect()] == ["MODERATE", "COMPLEX", "COMPLEX"]


@pytest.mark.parametrize("values, want", [([], None), ([5.0], 4.0), ([5.0, 5.0], 4.0), ([0.0, 20.0, 40.0], 10.0)])
def test_tolerance(spark, values, want):
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate(values)], "p int, y double, i int")
    rows = N.baseline_tolerance(df, ["p"], "y", "i").collect()
    assert [r["tolerance"] for r in rows] == ([] if want is None else [want])


def test_appendix_letters(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 26, 27, 52, 702, 703)], "n long")
    assert [r[0] for r in df.orderBy("n").select(S.appendix_letters(F.col("n"))).collect()] == ["A", "A", "Z", "AA", "AZ", "ZZ", "AAA"]


def test_xml_characters(spark):
    df = spark.createDataFrame([("a\x00b\tc￾d\U0001f600",), (None,)], "t string")
    assert [r[0] for r in df.select(S.strip_invalid_xml(F.col("t"))).collect()] == ["ab\tcd\U0001f600", ""]


def test_packages(spark):
    good = K.package_bytes([("a.xml", "<a/>"), ("b.bin", "x")])
    broken = bytearray(good)
    broken[broken.find(b"<a/>") if b"<a/>" in good else 40] ^= 0xFF
    assert [e[0] for e in R.package_entries(good)] == ["a.xml", "b.bin"] and R.package_entries(b"no")[0][3].startswith("not a package")
    assert any(e[3] for e in R.package_entries(bytes(broken)))


def test_chains(spark):
    seen = []
    chain = X.Chain(hooks=[lambda name, df: seen.append(name)]).register("fixer", "two", lambda df: df.withColumn("x", F.lit(2))).register("adapter", "one", lambda df: df.limit(1))
    assert chain.run(spark.range(5)).collect()[0]["x"] == 2 and seen == ["one", "two"]
    with pytest.raises(ValueError):
        chain.register("other", "x", lambda df: df)


def test_the_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
