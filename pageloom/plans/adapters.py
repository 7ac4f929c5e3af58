"""Views of the driver's tables in the shapes the operators work on, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion records: one for each order, counts from its lines, publisher from the customer's nation."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("num_pages"), F.count_if(F.col("l_returnflag") == "R").alias("num_tables"),
        F.count_if(F.col("l_linestatus") == "O").alias("num_raster_images"), F.max("l_linenumber").cast("bigint").alias("num_chapters"),
    )
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(nations, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "P", "Completed").when(F.col("o_orderstatus") == "F", "failed").otherwise("processing")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("job_key"), (F.col("o_orderkey") % 500).cast("string").alias("isbn"),
        status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("n_name").alias("publisher"), F.col("o_orderpriority").alias("conversion_type"),
        "num_pages", "num_tables", "num_raster_images", "num_chapters", F.floor("o_totalprice").cast("bigint").alias("duration_seconds"),
    )


CONVERSIONS_SQL = """
conv AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey AS job_key, CAST(o_orderkey % 500 AS VARCHAR) AS isbn,
         CASE o_orderstatus WHEN 'P' THEN 'Completed' WHEN 'F' THEN 'failed' ELSE 'processing' END AS status,
         o_orderdate AS created_at, n_name AS publisher, o_orderpriority AS conversion_type,
         num_pages, num_tables, num_raster_images, num_chapters, CAST(floor(o_totalprice) AS BIGINT) AS duration_seconds
  FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS num_pages, count(*) FILTER (l_returnflag = 'R') AS num_tables,
                    count(*) FILTER (l_linestatus = 'O') AS num_raster_images, CAST(max(l_linenumber) AS BIGINT) AS num_chapters
             FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
  LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files: one for each order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("file_id"), F.col("l_orderkey").alias("isbn"),
        F.col("l_returnflag").alias("file_type"), (F.col("l_quantity").cast("bigint") * 10000).alias("length"), F.col("l_shipdate").alias("upload_date"),
    )


FILES_SQL = """
files AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS file_id, l_orderkey AS isbn, l_returnflag AS file_type,
         CAST(l_quantity AS BIGINT) * 10000 AS length, l_shipdate AS upload_date
  FROM lineitem
)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text fragments: one for each line of each document, with whole-number geometry."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    n = F.length("text")
    return rows.select(
        "doc_id", F.floor(F.col("i") / 8).cast("bigint").alias("page"), F.col("i").cast("bigint").alias("stream_index"), "text",
        ((F.col("i") % 8) * 12 + (n % 3)).cast("bigint").alias("top"), (10 * (n % 7)).cast("bigint").alias("left"), (6 * (n % 60)).cast("bigint").alias("width"),
        (10 + n % 5).cast("bigint").alias("height"), (8 + n % 9).cast("bigint").alias("font_size"), (n % 2 == 0).alias("bold"), n.cast("bigint").alias("n_chars"),
    )


FRAGMENTS_SQL = """
frag AS (
  SELECT doc_id, CAST(i // 8 AS BIGINT) AS page, CAST(i AS BIGINT) AS stream_index, text,
         CAST((i % 8) * 12 + length(text) % 3 AS BIGINT) AS top, CAST(10 * (length(text) % 7) AS BIGINT) AS "left", CAST(6 * (length(text) % 60) AS BIGINT) AS width,
         CAST(10 + length(text) % 5 AS BIGINT) AS height, CAST(8 + length(text) % 9 AS BIGINT) AS font_size, length(text) % 2 = 0 AS bold, CAST(length(text) AS BIGINT) AS n_chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on pages: order lines, the order being the page."""
    d = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 400).cast("bigint"), (F.col("l_suppkey") * 7 % 600).cast("bigint")
    w, h = F.col("l_quantity").cast("bigint") * 4 + 10, (F.col("l_extendedprice").cast("bigint") % 150) + 10
    return d.select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("box"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"),
        F.col("l_returnflag").alias("kind"),
    )


BOXES_SQL = """
boxes AS (
  SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS box, CAST(l_partkey % 400 AS BIGINT) AS x0, CAST(l_suppkey * 7 % 600 AS BIGINT) AS y0,
         CAST(l_partkey % 400 AS BIGINT) + CAST(l_quantity AS BIGINT) * 4 + 10 AS x1,
         CAST(l_suppkey * 7 % 600 AS BIGINT) + CAST(floor(l_extendedprice) AS BIGINT) % 150 + 10 AS y1, l_returnflag AS kind
  FROM lineitem
)"""


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity inputs of pages: an order is a document, a line number a page."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_num"), (F.col("l_partkey") % 3).cast("bigint").alias("table_count"),
        (F.col("l_suppkey") % 2).cast("bigint").alias("image_count"), (F.col("l_partkey") % 9).cast("bigint").alias("drawing_count"),
        (F.col("l_suppkey") % 3 + 1).cast("bigint").alias("column_count"),
    )


PAGES_SQL = """
pc AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_num, CAST(l_partkey % 3 AS BIGINT) AS table_count, CAST(l_suppkey % 2 AS BIGINT) AS image_count,
         CAST(l_partkey % 9 AS BIGINT) AS drawing_count, CAST(l_suppkey % 3 + 1 AS BIGINT) AS column_count
  FROM lineitem
)"""
