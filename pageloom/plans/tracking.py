"""Queries over conversion records, stored files and page counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as T
from .adapters import CONVERSIONS_SQL, FILES_SQL, PAGES_SQL, conversions, files, page_counts, table

NOW = "1998-08-01 12:00:00"
_now = lambda: F.to_timestamp(F.lit(NOW))
_conv = lambda s, d: T.normalise(conversions(s, d))
_NORMAL = CONVERSIONS_SQL + """,
c AS (SELECT * REPLACE (CASE lower(status) WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'failure' WHEN 'processing' THEN 'in_progress' ELSE status END AS status,
  coalesce(num_pages, 0) AS num_pages, coalesce(num_tables, 0) AS num_tables, coalesce(num_raster_images, 0) AS num_raster_images, coalesce(num_chapters, 0) AS num_chapters) FROM conv)"""
_COLUMNS = ["job_id", "status", "created_at", "publisher", "num_pages"]
_LIST = ", ".join(_COLUMNS)


def _pages(s, d):
    return T.page_complexity(page_counts(s, d))


_SCORED = PAGES_SQL + """,
p AS (SELECT *, CAST((CASE WHEN table_count > 0 THEN 5 ELSE 0 END) + (CASE WHEN image_count > 0 THEN 4 ELSE 0 END) AS INTEGER) AS score,
  CASE WHEN table_count > 0 AND image_count > 0 THEN 'HIGHLY_COMPLEX' WHEN table_count > 0 OR image_count > 0 THEN 'COMPLEX'
       WHEN column_count > 1 OR drawing_count > 5 THEN 'MODERATE' ELSE 'SIMPLE' END AS level,
  table_count > 0 OR image_count > 0 AS route_to_ai,
  concat_ws(',', CASE WHEN table_count > 0 THEN 'tables' END, CASE WHEN image_count > 0 THEN 'images' END, CASE WHEN column_count > 1 THEN 'columns' END, CASE WHEN drawing_count > 5 THEN 'drawings' END) AS reasons
  FROM pc)"""


def _errors(s, d):
    o = table(s, d, "orders")
    severity = F.when(F.col("o_orderstatus") == "F", "Error").otherwise("Warning")
    return o.select(F.concat(F.lit("ch"), (F.col("o_custkey") % 40).cast("string"), F.lit(".xml")).alias("xml_file"), F.col("o_orderpriority").alias("error_type"), severity.alias("severity"))


def _done(pages):
    return pages.filter((F.col("page_num") * 7 + F.col("doc_id")) % 3 == 0)


QUERIES = {
    "agg_01_totals": lambda s, d: T.totals(_conv(s, d)),
    "agg_02_by_status": lambda s, d: T.count_by(_conv(s, d), "status"),
    "agg_03_by_type": lambda s, d: T.count_by(_conv(s, d), "conversion_type"),
    "agg_04_facets": lambda s, d: T.facets(_conv(s, d)),
    "agg_05_daily": lambda s, d: T.daily(_conv(s, d)),
    "agg_06_publishers": lambda s, d: T.publishers(_conv(s, d)),
    "agg_07_dashboard": lambda s, d: T.dashboard(_conv(s, d), _now()),
    "agg_08_tracker": lambda s, d: T.tracker_statistics(conversions(s, d)),
    "agg_09_storage": lambda s, d: T.storage_totals(files(s, d)),
    "agg_10_storage_by_type": lambda s, d: T.storage_by_type(files(s, d)),
    "agg_11_errors": lambda s, d: T.error_counts(_errors(s, d)),
    "agg_12_complexity": lambda s, d: T.complexity_report(_pages(s, d)),
    "src_01_list": lambda s, d: T.list_conversions(_conv(s, d), "success", 50, 10).select(_COLUMNS),
    "src_02_by_id": lambda s, d: T.find_by_id(_conv(s, d), "7").select(_COLUMNS),
    "src_03_by_isbn": lambda s, d: T.find_by_isbn(_conv(s, d), "33").select(_COLUMNS),
    "src_04_upsert": lambda s, d: T.upsert_latest(table(s, d, "events").select("user_id", "event_type", "value", "event_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]),
    "src_06_jobs": lambda s, d: T.list_conversions(_conv(s, d)).select(_COLUMNS),
    "src_07_restart": lambda s, d: T.load_jobs(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "converting").when(F.col("o_orderstatus") == "P", "editing").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("error"))),
    "src_09_files": lambda s, d: T.list_files(files(s, d), 7, ["N", "R"]).select("file_id", "file_type", "length"),
    "src_10_exists": lambda s, d: files(s, d).filter("isbn = 7").agg((F.count(F.lit(1)) > 0).alias("there"), F.max("length").alias("largest")),
    "flt_01_status": lambda s, d: _conv(s, d).filter("status = 'failure'").select("job_id"),
    "flt_02_recent": lambda s, d: T.list_conversions(_conv(s, d), limit=10).select("job_id", "status", "publisher"),
    "flt_03_since": lambda s, d: T.created_since(_conv(s, d), F.date_trunc("day", _now()) - F.expr("interval 7 days")).select("job_id", "created_at"),
    "flt_11_route": lambda s, d: T.route_pages(_pages(s, d), [1, 2], [2, 3]).select("doc_id", "page_num", "route_to_ai"),
    "flt_12_level": lambda s, d: _pages(s, d).select("doc_id", "page_num", "score", "level", "route_to_ai", "reasons"),
    "flt_13_outputs": lambda s, d: table(s, d, "part").select("p_partkey", T.classify_output(F.concat(F.regexp_replace("p_name", " ", "_"), F.element_at(F.array(F.lit("_temp.xml"), F.lit(".zip"), F.lit(".log")), (F.col("p_partkey") % 3 + 1).cast("int")))).alias("kind")),
    "sort_01_newest": lambda s, d: T.list_conversions(_conv(s, d)).select("job_id", "created_at"),
    "sort_02_page": lambda s, d: T.list_conversions(_conv(s, d), limit=20, skip=40).select("job_id", "created_at"),
    "sort_03_recent": lambda s, d: T.list_conversions(_conv(s, d), limit=10).select("job_id", "created_at"),
    "sort_04_publishers": lambda s, d: T.publishers(_conv(s, d), 20, True).select("publisher", "total"),
    "set_01_merge": lambda s, d: T.count_by(_conv(s, d).select("status").unionByName(conversions(s, d).select("status")), "status"),
    "set_02_right_wins": lambda s, d: T.merge_results(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("left").alias("side")).distinct(), table(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.lit("right").alias("side")), "k"),
    "set_03_left": lambda s, d: T.pages_left(page_counts(s, d), _done(page_counts(s, d))).select("doc_id", "page_num"),
    "set_03_resume": lambda s, d: T.pages_left(page_counts(s, d), _done(page_counts(s, d)), True).select("doc_id", "page_num"),
    "set_05_union": lambda s, d: T.upsert_latest(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.lit(2).alias("r")).unionByName(table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), F.lit(1).alias("r"))), "k", [F.col("r")]),
    "dt_01_parse": lambda s, d: table(s, d, "orders").select("o_orderkey", T.parse_time(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")).cast("timestamp_ntz").alias("at")),
    "dt_02_label": lambda s, d: conversions(s, d).select("job_id", T.duration_label(F.col("duration_seconds") % 5).alias("label")),
    "dt_03_day": lambda s, d: table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("midnight")),
    "math_02_percent": lambda s, d: conversions(s, d).select("job_id", T.safe_ratio(F.col("num_tables"), F.col("num_pages")).alias("share"), T.clamp_percent(F.col("duration_seconds") % 300 - 100).alias("held")),
    "map_01_counters": lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws("=", x["event_type"], x["n"].cast("string"))), ",").alias("counters")),
}

_RECENT = f"SELECT job_id, created_at FROM c ORDER BY c.created_at DESC, job_key"
ORACLE_SQL = {
    "agg_01_totals": f"WITH {_NORMAL} SELECT count(*) AS total, CAST(coalesce(sum(num_pages), 0) AS BIGINT) AS total_pages, CAST(coalesce(sum(num_raster_images), 0) AS BIGINT) AS total_images, CAST(coalesce(sum(num_tables), 0) AS BIGINT) AS total_tables, CAST(coalesce(sum(num_chapters), 0) AS BIGINT) AS total_chapters, round_even(coalesce(avg(duration_seconds), 0.0), 2) AS avg_duration FROM c",
    "agg_02_by_status": f"WITH {_NORMAL} SELECT status, count(*) AS n FROM c GROUP BY 1",
    "agg_03_by_type": f"WITH {_NORMAL} SELECT conversion_type, count(*) AS n FROM c GROUP BY 1",
    "agg_04_facets": f"WITH {_NORMAL} SELECT 'status' AS facet, status AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'type', conversion_type, count(*) FROM c GROUP BY 2",
    "agg_05_daily": f"WITH {_NORMAL} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failure') AS failed, CAST(sum(num_pages) AS BIGINT) AS pages, CAST(sum(num_raster_images) AS BIGINT) AS images FROM c GROUP BY 1",
    "agg_06_publishers": f"WITH {_NORMAL} SELECT publisher, count(*) AS total, count(*) FILTER (status = 'success') AS successful, CAST(sum(num_pages) AS BIGINT) AS pages FROM c WHERE publisher IS DISTINCT FROM '' GROUP BY 1 ORDER BY total DESC, publisher NULLS FIRST LIMIT 20",
    "agg_07_dashboard": f"WITH {_NORMAL} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failure') AS failed, count(*) FILTER (status IN ('in_progress', 'processing')) AS in_progress, count(*) FILTER (created_at >= TIMESTAMP '1998-08-01') AS today, count(*) FILTER (created_at >= TIMESTAMP '1998-07-25 12:00:00') AS last_week, round_even(coalesce(avg(duration_seconds) FILTER (status = 'success'), 0.0), 2) AS avg_duration_completed FROM c",
    "agg_08_tracker": f"WITH {CONVERSIONS_SQL} SELECT conversion_type, count(*) AS total, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(num_pages), 0) AS BIGINT) AS pages, round_even(100.0 * count(*) FILTER (status = 'Completed') / CAST(count(*) AS DOUBLE), 1) AS success_rate FROM conv WHERE conversion_type IS NOT NULL GROUP BY 1",
    "agg_09_storage": f"WITH {FILES_SQL} SELECT count(*) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes, count(DISTINCT isbn) AS books, round_even(CAST(sum(length) AS DOUBLE) / 1048576, 2) AS megabytes FROM files",
    "agg_10_storage_by_type": f"WITH {FILES_SQL} SELECT isbn, file_type, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, CAST(grouping(file_type) AS INTEGER) AS is_total FROM files GROUP BY GROUPING SETS ((isbn, file_type), (isbn))",
    "agg_11_errors": "WITH e AS (SELECT concat('ch', o_custkey % 40, '.xml') AS xml_file, o_orderpriority AS error_type, CASE WHEN o_orderstatus = 'F' THEN 'Error' ELSE 'Warning' END AS severity FROM orders) SELECT 'type' AS facet, error_type AS key, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'file', xml_file, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'severity', k, count(severity) FROM (VALUES ('Error'), ('Warning'), ('Info')) v(k) LEFT JOIN e ON severity = k GROUP BY 2",
    "agg_12_complexity": f"WITH {_SCORED} SELECT doc_id, count(*) AS pages, count(*) FILTER (route_to_ai) AS ai_pages, count(*) FILTER (level = 'SIMPLE') AS simple, count(*) FILTER (level = 'MODERATE') AS moderate, count(*) FILTER (level = 'COMPLEX') AS complex, count(*) FILTER (level = 'HIGHLY_COMPLEX') AS highly_complex, CAST(sum(table_count) AS BIGINT) AS tables, max(table_count) AS most_tables, CAST(sum(image_count) AS BIGINT) AS images, round_even(CAST(sum(score) AS DOUBLE) / count(*), 3) AS avg_score, round_even(100.0 * count(*) FILTER (route_to_ai) / CAST(count(*) AS DOUBLE), 1) AS ai_percent, coalesce(string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) FILTER (route_to_ai), '') AS ai_page_list FROM p GROUP BY 1",
    "src_01_list": f"WITH {_NORMAL} SELECT {_LIST} FROM c WHERE status = 'success' ORDER BY created_at DESC, job_key LIMIT 50 OFFSET 10",
    "src_02_by_id": f"WITH {_NORMAL} SELECT {_LIST} FROM c WHERE job_id = '7' LIMIT 1",
    "src_03_by_isbn": f"WITH {_NORMAL} SELECT {_LIST} FROM c WHERE isbn = '33' OR job_id = '33' ORDER BY job_key LIMIT 1",
    "src_04_upsert": "SELECT user_id, event_type, value, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "src_06_jobs": f"WITH {_NORMAL} SELECT {_LIST} FROM c ORDER BY created_at DESC, job_key LIMIT 50",
    "src_07_restart": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'failed' ELSE 'completed' END AS status, CASE o_orderstatus WHEN 'O' THEN 'interrupted by restart' END AS error FROM orders",
    "src_09_files": f"WITH {FILES_SQL} SELECT file_id, file_type, length FROM files WHERE isbn = 7 AND file_type IN ('N', 'R')",
    "src_10_exists": f"WITH {FILES_SQL} SELECT count(*) > 0 AS there, max(length) AS largest FROM files WHERE isbn = 7",
    "flt_01_status": f"WITH {_NORMAL} SELECT job_id FROM c WHERE status = 'failure'",
    "flt_02_recent": f"WITH {_NORMAL} SELECT job_id, status, publisher FROM c ORDER BY created_at DESC, job_key LIMIT 10",
    "flt_03_since": f"WITH {_NORMAL} SELECT job_id, created_at FROM c WHERE created_at >= TIMESTAMP '1998-07-25'",
    "flt_11_route": f"WITH {_SCORED} SELECT doc_id, page_num, CASE WHEN page_num IN (2, 3) THEN false WHEN page_num IN (1, 2) THEN true ELSE route_to_ai END AS route_to_ai FROM p",
    "flt_12_level": f"WITH {_SCORED} SELECT doc_id, page_num, score, level, route_to_ai, reasons FROM p",
    "flt_13_outputs": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'intermediate' WHEN 1 THEN 'final' END AS kind FROM part",
    "sort_01_newest": f"WITH {_NORMAL} {_RECENT} LIMIT 50",
    "sort_02_page": f"WITH {_NORMAL} {_RECENT} LIMIT 20 OFFSET 40",
    "sort_03_recent": f"WITH {_NORMAL} {_RECENT} LIMIT 10",
    "sort_04_publishers": f"WITH {_NORMAL} SELECT publisher, count(*) AS total FROM c WHERE publisher <> '' GROUP BY 1 ORDER BY total DESC, publisher LIMIT 20",
    "set_01_merge": f"WITH {_NORMAL} SELECT status, count(*) AS n FROM (SELECT status FROM c UNION ALL SELECT status FROM conv) GROUP BY 1",
    "set_02_right_wins": "SELECT k, max(side) AS side FROM (SELECT DISTINCT s_nationkey AS k, 'left' AS side FROM supplier UNION ALL SELECT n_nationkey, 'right' FROM nation WHERE n_regionkey = 1) GROUP BY 1",
    "set_03_left": f"WITH {PAGES_SQL} SELECT doc_id, page_num FROM pc WHERE (page_num * 7 + doc_id) % 3 <> 0",
    "set_03_resume": f"WITH {PAGES_SQL} SELECT doc_id, page_num FROM pc LEFT JOIN (SELECT doc_id AS k, max(page_num) AS last FROM pc WHERE (page_num * 7 + doc_id) % 3 = 0 GROUP BY 1) ON doc_id = k WHERE page_num > coalesce(last, 0)",
    "set_05_union": "SELECT k, max(r) AS r FROM (SELECT p_partkey AS k, 2 AS r FROM part UNION ALL SELECT l_partkey, 1 FROM lineitem) GROUP BY 1",
    "dt_01_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE date_trunc('second', o_orderdate) END AS at FROM orders",
    "dt_02_label": f"WITH {CONVERSIONS_SQL} SELECT job_id, CASE WHEN duration_seconds % 5 = 0 THEN 'N/A' ELSE concat(duration_seconds % 5, 's') END AS label FROM conv",
    "dt_03_day": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(date_trunc('day', ts) AS TIMESTAMP) AS midnight FROM events",
    "math_02_percent": f"WITH {CONVERSIONS_SQL} SELECT job_id, coalesce(round_even(100.0 * num_tables / CAST(num_pages AS DOUBLE), 1), 0.0) AS share, greatest(0, least(100, duration_seconds % 300 - 100)) AS held FROM conv",
    "map_01_counters": "SELECT user_id, string_agg(concat(event_type, '=', n), ',' ORDER BY event_type) AS counters FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
}
