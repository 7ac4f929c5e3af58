"""Sources: layout and media XML, metadata files, spreadsheets, packages, stored files, outlines."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import strings as S
from ..shipping import ship

TEXT = T.StructType([T.StructField(f"_{n}", k) for n, k in (("top", T.DoubleType()), ("left", T.DoubleType()), ("width", T.DoubleType()), ("height", T.DoubleType()), ("font", T.StringType()))] + [T.StructField("_VALUE", T.StringType())])
PAGE = T.StructType([T.StructField("_number", T.IntegerType()), T.StructField("_width", T.DoubleType()), T.StructField("_height", T.DoubleType()), T.StructField("text", T.ArrayType(TEXT))])
MEDIUM = T.StructType([T.StructField(f"_{n}", k) for n, k in (("id", T.StringType()), ("type", T.StringType()), ("file", T.StringType()), ("render_mode", T.StringType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()), ("x2", T.DoubleType()), ("y2", T.DoubleType()))] + [T.StructField("caption", T.StringType())])
MEDIA_PAGE = T.StructType([T.StructField("_index", T.IntegerType()), T.StructField("media", T.ArrayType(MEDIUM))])


def layout(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Text fragments of layout XML: one row for each text of each page. ``keys``: further attributes of pages, in DDL."""
    more = T.StructType.fromDDL(keys).fields if keys else []
    schema = T.StructType([T.StructField(f"_{k.name}", k.dataType) for k in more] + PAGE.fields)
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    rows = pages.select(*(F.col(f"_{k.name}").alias(k.name) for k in more), F.col("_number").alias("page"), F.col("_width").alias("page_width"), F.col("_height").alias("page_height"), F.posexplode("text").alias("stream_index", "t"))
    return rows.select(*(k.name for k in more), "page", "page_width", "page_height", "stream_index", F.col("t._VALUE").alias("text"), *(F.col(f"t._{n}").alias(n) for n in ("top", "left", "width", "height", "font")), (F.col("t._top") + F.col("t._height")).alias("baseline"))


def media(spark: SparkSession, path: str) -> DataFrame:
    """Media of pages with their rectangles."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(MEDIA_PAGE).load(path)
    rows = pages.select(F.col("_index").alias("page"), F.explode("media").alias("m"))
    return rows.select("page", *(F.col(f"m._{n}").alias(n) for n in ("id", "type", "file", "render_mode", "x1", "y1", "x2", "y2")), "m.caption")


def full_page_images(found: DataFrame) -> DataFrame:
    """The first full-page image of each page."""
    return found.filter("render_mode = 'fullpage'").groupBy("page").agg(F.min("file").alias("file"))


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(field, value)`` of a metadata CSV in either layout: key and value columns, or a heading with one row of values."""
    rows = spark.read.option("header", "false").option("mode", "PERMISSIVE").schema(", ".join(f"c{i} string" for i in range(24))).csv(path)
    seen = rows.agg(F.count_if(F.col("c2").isNotNull()).alias("wide"), F.count(F.lit(1)).alias("n")).first()
    if seen["wide"] and seen["n"] >= 2:
        numbered = rows.withColumn("__n", F.monotonically_increasing_id())
        cells = numbered.select("__n", F.posexplode(F.array(*(f"c{i}" for i in range(24)))).alias("i", "v"))
        # the heading is the first row, so the smallest number of each column is the heading's
        heads = cells.groupBy("i").agg(F.min("__n").alias("__n"), F.min_by("v", "__n").alias("field"))
        chosen = cells.withColumnRenamed("__n", "__row").join(F.broadcast(heads), "i").filter("__row > __n").select("field", F.col("v").alias("value"))
    else:
        chosen = rows.select(F.col("c0").alias("field"), F.col("c1").alias("value"))
    return chosen.filter("field IS NOT NULL AND trim(value) <> '' AND lower(trim(field)) <> 'field' AND lower(trim(value)) NOT IN ('n/a', 'na', 'none')")


def metadata_pairs(cells: DataFrame) -> DataFrame:
    """``(path, field, value)`` of metadata workbooks in either layout, from ``sheet_cells``: two columns of fields and values, or a heading with one row of values."""
    sheets = cells.groupBy("path").agg(F.max(F.when(F.col("row") == 0, F.col("col"))).alias("__last"), F.max("row").alias("__rows")).withColumn("__wide", (F.col("__last") > 1) & (F.col("__rows") >= 1))
    placed = cells.join(sheets, "path")
    across = placed.filter("__wide AND row <= 1").groupBy("path", "col").agg(F.max(F.when(F.col("row") == 0, F.col("value"))).alias("field"), F.max(F.when(F.col("row") == 1, F.col("value"))).alias("value"))
    down = placed.filter("NOT __wide AND col <= 1").groupBy("path", "row").agg(F.max(F.when(F.col("col") == 0, F.col("value"))).alias("field"), F.max(F.when(F.col("col") == 1, F.col("value"))).alias("value"))
    return across.select("path", "field", "value").union(down.select("path", "field", "value")).filter("field IS NOT NULL AND trim(value) <> ''")


def book_record(pairs: DataFrame) -> DataFrame:
    """One record of known fields from (field, value) rows; the last value counts, authors are joined."""
    return _records(pairs)


def book_records(pairs: DataFrame, key: str) -> DataFrame:
    """One record for each key of (key, field, value) rows."""
    return _records(pairs, key)


def _records(pairs: DataFrame, *keys: str) -> DataFrame:
    known = pairs.withColumn("name", S.field_name(F.col("field"))).filter("name IS NOT NULL")
    of = lambda n: F.max(F.when(F.col("name") == n, F.trim("value")))
    authors = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("name") == "authors", S.split_authors(F.col("value"))))))
    return known.groupBy(*keys).agg(
        F.max(F.when(F.col("name") == "isbn", S.isbn_clean(F.col("value")))).alias("isbn"), *(of(n).alias(n) for n in ("title", "subtitle", "publisher", "pubdate", "edition", "copyright_holder")),
        F.array_sort(authors).alias("authors"), F.max(F.when(F.col("name") == "copyright_year", F.coalesce(S.year(F.col("value")), F.trim("value")))).alias("copyright_year"),
    )


def is_onix(head: Column) -> Column:
    return F.lower(F.substring(head, 1, 2000)).rlike("<onixmessage|<product>|<product |onix")


def onix(spark: SparkSession, path: str) -> DataFrame:
    """Products of ONIX 2.1 and 3.0 files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("x"))
    bare = F.regexp_replace(F.regexp_replace("x", r"(?s)<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", ""), r'\sxmlns="[^"]*"', "")
    products = files.filter(is_onix(F.col("x"))).select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)(<Product[ >].*?</Product>)"), F.lit(1))).alias("p"))
    at = lambda q: F.xpath_string("p", F.lit(q))
    return products.select(
        "path", at("//ProductIdentifier[ProductIDType='15']/IDValue").alias("isbn"), at("//TitleText").alias("title"), at("//Subtitle").alias("subtitle"),
        F.xpath("p", F.lit("//Contributor/PersonName/text()")).alias("authors"), at("//PublisherName").alias("publisher"), at("//PublicationDate | //PublishingDate/Date").alias("pubdate"),
    )


def sheet_rows(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of a spreadsheet package, rows and columns from 0."""
    def numbers(ref: str) -> tuple[int, int]:
        m = re.match(r"([A-Z]+)([0-9]+)", ref)
        column = 0
        for c in m[1]:
            column = column * 26 + ord(c) - 64
        return int(m[2]) - 1, column - 1

    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        tree = lambda n: ET.fromstring(z.read(n))
        plain = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
        shared = [plain(e) for e in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        titles = [e.get("name") for e in tree("xl/workbook.xml").iter() if e.tag.endswith("}sheet")]
        for k, name in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))):
            for c in (e for e in tree(name).iter() if e.tag.endswith("}c")):
                value = next((v.text or "" for v in c if v.tag.endswith("}v")), None)
                if c.get("t") == "s":
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = plain(c)
                if value is not None:
                    row, column = numbers(c.get("r"))
                    out.append((titles[k] if k < len(titles) else name, row, column, value))
    return out


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the spreadsheets below a path."""
    return sheet_cells(spark.read.format("binaryFile").load(path).select("path", "content"))


def sheet_cells(files: DataFrame) -> DataFrame:
    """Cells ``(path, sheet, row, col, value)`` of ``(path, content)``; a file that is no spreadsheet has no rows."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows += [(name, *r) for r in sheet_rows(data.as_py())]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "sheet", "row", "col", "value"])

    return files.mapInArrow(run, "path string, sheet string, row int, col int, value string")


def header_name(raw: Column) -> Column:
    """A spreadsheet heading as a field name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def records(cells: DataFrame) -> DataFrame:
    """Rows of a sheet as maps from heading to value; the first row is the heading."""
    heads = cells.filter("row = 0").select("path", "sheet", "col", header_name(F.col("value")).alias("name"))
    joined = cells.filter("row > 0").join(heads, ["path", "sheet", "col"])
    return joined.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("record"))


def package_entries(data: bytes) -> list[tuple[str, int, str, str]]:
    """(name, size, text, error) of a ZIP; an entry that fails its checksum is a row with its error."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        return [("", 0, "", f"not a package: {e}")]
    out = []
    with z:
        for info in z.infolist():
            try:
                raw = z.read(info)
                out.append((info.filename, info.file_size, raw.decode("utf-8", "replace") if info.filename.lower().endswith((".xml", ".csv", ".txt", ".ent")) else "", ""))
            except (zipfile.BadZipFile, zlib.error, EOFError) as e:
                out.append((info.filename, info.file_size, "", f"{type(e).__name__}: {e}"))
    return out


def packages(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Entries of packages, broken ones as rows with an error."""
    ship(files.sparkSession)
    narrow = files.select(F.col(key), F.col(content).alias("__c"))

    def run(batches):
        for b in batches:
            made = [package_entries(x.as_py() or b"") for x in b.column(1)]
            who = [i for i, m in enumerate(made) for _ in m]
            flat = list(zip(*(r for m in made for r in m), strict=True)) or [[]] * 4
            columns = [pa.array(c, k) for c, k in zip(flat, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *columns], names=[key, "entry", "size", "text", "error"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, entry string, size bigint, text string, error string")


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """Declared external entities: ``(key, n, entity, system)``."""
    pattern = r'<!ENTITY\s+([A-Za-z0-9_.-]+)\s+SYSTEM\s+"([^"]*)"\s*>'
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("entity"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("system"))
    return df.select(key, F.posexplode(pairs).alias("n", "e")).select(key, "n", "e.entity", "e.system")


def outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """Preorder rows ``(key, seq, level, title, start_page)`` of an outline with nested items; pages from 0."""
    pattern = r'(<item\b[^>]*page="[0-9]+"[^>]*>|<outline>|</outline>)([^<]*)'
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("title"))
    rows = df.select(key, F.posexplode(parts).alias("seq", "p"))
    step = F.when(F.col("p.tag") == "<outline>", 1).when(F.col("p.tag") == "</outline>", -1).otherwise(0)
    depth = F.sum(step).over(W.Window.partitionBy(key).orderBy("seq").rowsBetween(W.Window.unboundedPreceding, 0))
    leveled = rows.withColumn("level", depth.cast("int")).filter(F.col("p.tag").startswith("<item"))
    return leveled.select(key, "seq", "level", F.trim("p.title").alias("title"), (F.regexp_extract("p.tag", 'page="([0-9]+)"', 1).cast("int") - 1).alias("start_page"))


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as storage rows: the folder name is the book, the extension the type."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return found.select(name.alias("filename"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("isbn"), S.file_type(name).alias("file_type"), "length", F.col("modificationTime").alias("upload_date"))
