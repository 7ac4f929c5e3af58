"""Conversion tracking: normalising, look-ups, listings, aggregates and dashboards.

All operators are DataFrame to DataFrame. ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Status spellings and what they become; others stay as they are.
STATUS = {
    "completed": "success", "complete": "success", "success": "success", "failed": "failure", "failure": "failure", "error": "failure",
    "partial": "partial", "partial success": "partial", "in_progress": "in_progress", "in progress": "in_progress", "processing": "in_progress", "pending": "in_progress",
}
IN_PROGRESS = ("pending", "processing", "extracting", "converting", "validating", "packaging", "in_progress")
TERMINAL = ("success", "failure", "partial", "completed", "failed", "cancelled")
KIB, MIB = 1024, 1024 * 1024


def status_of(raw: Column) -> Column:
    """The normal form of a status; an unknown one stays, lower-cased spelling decides."""
    pairs = F.create_map(*(x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(pairs, F.lower(F.trim(raw))), raw)


def normalise(df: DataFrame) -> DataFrame:
    """Status in its normal form, null counters as zero."""
    counters = [c for c in df.columns if c.startswith("num_")]
    return df.withColumns({"status": status_of(F.col("status")), **{c: F.coalesce(F.col(c), F.lit(0)) for c in counters}})


def parse_time(text: Column) -> Column:
    """ISO with offset or Z, else ``yyyy-MM-dd HH:mm:ss``, else null."""
    iso = F.regexp_replace(text, "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def duration(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def duration_label(seconds: Column) -> Column:
    """``"<n>s"``, or ``N/A`` for null and zero."""
    whole = F.floor(seconds)
    return F.when(whole.isNull() | (whole == 0), "N/A").otherwise(F.concat(whole.cast("string"), F.lit("s")))


def clamp_percent(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def safe_ratio(a: Column, b: Column, digits: int = 1) -> Column:
    """100 * a / b rounded half to even; zero for an empty whole."""
    return F.coalesce(F.bround(F.try_divide(100.0 * a, b), digits), F.lit(0.0))


def upsert_latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The latest row for each key; a grouped maximum, so no key's rows are gathered."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*(F.col(c) if c == key else F.col("__row").getField(c).alias(c) for c in df.columns))


def list_conversions(df: DataFrame, status: str | None = None, limit: int = 50, skip: int = 0, sort_by: str = "created_at", tie: str = "job_key") -> DataFrame:
    chosen = df if status is None else df.filter(F.col("status") == status)
    return chosen.orderBy(F.col(sort_by).desc(), F.col(tie)).offset(skip).limit(limit)


def find_by_id(df: DataFrame, job_id: str) -> DataFrame:
    return df.filter(F.col("job_id") == job_id).limit(1)


def find_by_isbn(df: DataFrame, value: str, tie: str = "job_key") -> DataFrame:
    return df.filter((F.col("isbn") == value) | (F.col("job_id") == value)).orderBy(tie).limit(1)


def created_since(df: DataFrame, start: Column) -> DataFrame:
    return df.filter(F.col("created_at") >= start)


def totals(df: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("total"), zero("num_pages").alias("total_pages"), zero("num_raster_images").alias("total_images"), zero("num_tables").alias("total_tables"),
        zero("num_chapters").alias("total_chapters"), F.bround(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)), 2).alias("avg_duration"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows for each value; null is a value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame) -> DataFrame:
    """Counts by status and by type from one scan."""
    sets = df.groupingSets([["status"], ["conversion_type"]], "status", "conversion_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "status").otherwise("type").alias("facet"), F.when(F.col("g") == 0, F.col("status")).otherwise(F.col("conversion_type")).alias("value"), "n")


def dashboard(df: DataFrame, now: Column) -> DataFrame:
    """All headline numbers of a dashboard in one aggregate."""
    today, week = F.date_trunc("day", now), now - F.expr("interval 7 days")
    at = F.col("created_at").cast("timestamp")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "failure").alias("failed"),
        F.count_if(F.col("status").isin("in_progress", "processing")).alias("in_progress"), F.count_if(at >= today).alias("today"), F.count_if(at >= week).alias("last_week"),
        F.bround(F.coalesce(F.avg(F.when(F.col("status") == "success", F.col("duration_seconds"))), F.lit(0.0)), 2).alias("avg_duration_completed"),
    )


def daily(df: DataFrame, time: str = "created_at") -> DataFrame:
    return df.groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "failure").alias("failed"),
        F.sum("num_pages").cast("bigint").alias("pages"), F.sum("num_raster_images").cast("bigint").alias("images"),
    )


def publishers(df: DataFrame, limit: int = 20, exclude_null: bool = False) -> DataFrame:
    """The publishers with most conversions; an empty name is no publisher, a null one is kept unless excluded."""
    named = df.filter("publisher <> ''") if exclude_null else df.filter("NOT (publisher <=> '')")
    grouped = named.groupBy("publisher").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.sum("num_pages").cast("bigint").alias("pages"))
    return grouped.orderBy(F.col("total").desc(), F.col("publisher")).limit(limit)


def tracker_statistics(df: DataFrame) -> DataFrame:
    """Counts by exact status strings and type; a null type is skipped."""
    by_type = df.filter("conversion_type IS NOT NULL").groupBy("conversion_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("num_pages"), F.lit(0)).cast("bigint").alias("pages"),
    )
    return by_type.withColumn("success_rate", safe_ratio(F.col("completed"), F.col("total")))


def storage_totals(files: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    return files.agg(F.count(F.lit(1)).alias("files"), size.alias("bytes"), F.count_distinct("isbn").alias("books"), F.bround(size / MIB, 2).alias("megabytes"))


def storage_by_type(files: DataFrame, isbn: Column | None = None) -> DataFrame:
    """Count and bytes by book and file type, and each book's total (null type)."""
    chosen = files if isbn is None else files.filter(F.col("isbn") == isbn)
    sets = chosen.groupingSets([["isbn", "file_type"], ["isbn"]], "isbn", "file_type")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("length").cast("bigint").alias("bytes"), F.grouping("file_type").cast("int").alias("is_total"))


def list_files(files: DataFrame, isbn, types: list[str] | None = None) -> DataFrame:
    chosen = files.filter(F.col("isbn") == isbn)
    chosen = chosen if not types else chosen.filter(F.col("file_type").isin(types))
    return chosen.orderBy("file_id")


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors by type, file and severity; the three severities are there even with none."""
    seeded = errors.sparkSession.createDataFrame([("Error",), ("Warning",), ("Info",)], "key string")
    of = lambda c, name: errors.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit(name))
    severity = seeded.join(of("severity", "severity"), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.lit("severity").alias("facet"))
    return of("error_type", "type").unionByName(of("xml_file", "file")).unionByName(severity).select("facet", "key", "n")


def score_page(tables: Column, images: Column) -> Column:
    return F.when(tables > 0, 5).otherwise(0) + F.when(images > 0, 4).otherwise(0)


def page_level(tables: Column, images: Column, columns: Column, drawings: Column) -> Column:
    return (
        F.when((tables > 0) & (images > 0), "HIGHLY_COMPLEX").when((tables > 0) | (images > 0), "COMPLEX")
        .when((columns > 1) | (drawings > 5), "MODERATE").otherwise("SIMPLE")
    )


def page_complexity(pages: DataFrame) -> DataFrame:
    """Score, level, route and reasons of every page."""
    t, i, c, d = (F.col(x) for x in ("table_count", "image_count", "column_count", "drawing_count"))
    reasons = F.array_compact(F.array(F.when(t > 0, F.lit("tables")), F.when(i > 0, F.lit("images")), F.when(c > 1, F.lit("columns")), F.when(d > 5, F.lit("drawings"))))
    return pages.withColumns({"score": score_page(t, i), "level": page_level(t, i, c, d), "route_to_ai": (t > 0) | (i > 0), "reasons": F.array_join(reasons, ",")})


def route_pages(pages: DataFrame, force_ai: list[int], force_plain: list[int]) -> DataFrame:
    """Routes with overrides; a page in both lists goes the plain way. Pages outside the document are no rows, so cannot be forced."""
    n = F.col("page_num")
    route = F.when(n.isin(force_plain), F.lit(False)).when(n.isin(force_ai), F.lit(True)).otherwise(F.col("route_to_ai"))
    return pages.withColumn("route_to_ai", route)


def complexity_report(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Totals of each document's pages."""
    n = F.count(F.lit(1))
    return pages.groupBy(doc).agg(
        n.alias("pages"), F.count_if("route_to_ai").alias("ai_pages"), F.count_if(F.col("level") == "SIMPLE").alias("simple"), F.count_if(F.col("level") == "MODERATE").alias("moderate"),
        F.count_if(F.col("level") == "COMPLEX").alias("complex"), F.count_if(F.col("level") == "HIGHLY_COMPLEX").alias("highly_complex"),
        F.sum("table_count").cast("bigint").alias("tables"), F.max("table_count").alias("most_tables"), F.sum("image_count").cast("bigint").alias("images"),
        F.bround(F.sum("score") / n, 3).alias("avg_score"), F.bround(100.0 * F.count_if("route_to_ai") / n, 1).alias("ai_percent"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("route_to_ai"), F.col("page_num")))), lambda p: p.cast("string")), ",").alias("ai_page_list"),
    )


def merge_results(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the right one's row."""
    both = left.withColumn("__p", F.lit(0)).unionByName(right.withColumn("__p", F.lit(1)))
    return upsert_latest(both, key, [F.col("__p")]).drop("__p")


def pages_left(all_pages: DataFrame, done: DataFrame, resume: bool = False) -> DataFrame:
    """Pages not done; ``resume`` starts after the last one done, so gaps before it are skipped."""
    if resume:
        last = done.groupBy("doc_id").agg(F.max("page_num").alias("__last"))
        return all_pages.join(last, "doc_id", "left").filter(F.col("page_num") > F.coalesce("__last", F.lit(0))).drop("__last")
    return all_pages.join(done.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_anti")


def dense_levels(df: DataFrame, partition: str, order: Column, most: int) -> Column:
    return F.least(F.dense_rank().over(W.Window.partitionBy(partition).orderBy(order)), F.lit(most))


def load_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those being edited count as completed, those in flight as failed."""
    s = F.col("status")
    fixed = F.when(s == "editing", "completed").when(s.isin(*IN_PROGRESS), "failed").otherwise(s)
    return jobs.withColumns({"error": F.when(s.isin(*IN_PROGRESS), "interrupted by restart").otherwise(F.col("error")), "status": fixed})


def classify_output(name: Column) -> Column:
    """``intermediate``, ``final`` or null: an intermediate mark wins over a final suffix."""
    low = F.lower(name)
    return F.when(low.rlike("_intermediate|_temp|_debug|_raw|_unified|_columns|/tmp/"), "intermediate").when(low.rlike(r"\.(?:zip|docx|xml|json|xlsx|html)$"), "final")


def tracker_row(df: DataFrame) -> DataFrame:
    """Display columns: times as text, durations as labels, progress held to 0-100."""
    return df.withColumns({"start_time": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "duration": duration_label(F.col("duration_seconds")), "progress": clamp_percent(F.col("progress"))})
