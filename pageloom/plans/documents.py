"""Queries over markup, references, sources, sinks, extension points and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import joins as J
from ..operators import markup as M
from ..operators import tracking as T
from ..sources import extension as X
from ..sources import readers as R
from ..sources import writers as K
from ..streaming import jobs as B
from .adapters import CONVERSIONS_SQL, conversions, fragments, page_counts, table


def scratch(spark) -> str:
    """A fresh path below the shared checkpoint folder; a temporary one only in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='pageloom-scratch-')}/scratch/{uuid.uuid4().hex}"


# ---- chapters: an order is a chapter, its lines are blocks of three kinds ----
def _lines(s, d):
    """Lines of an order once each; ``o`` holds what they are ordered by, side by side, whatever the size of the keys."""
    keys = ("l_linenumber", "l_partkey", "l_suppkey")
    return table(s, d, "lineitem").select("l_orderkey", "l_returnflag", *keys).distinct().select("l_orderkey", "l_returnflag", F.struct(*keys).alias("o"))


def _chapters(s, d):
    block = (
        F.when(F.col("l_returnflag") == "R", "<para>out<para>in</para>  more</para>").when(F.col("l_returnflag") == "N", "<section><title>S</title><para>x</para></section>")
        .otherwise("<p>hello <b>w</b><br/></p><link linkend='gone'>t</link><imagedata/>")
    )
    parts = F.array_sort(F.collect_list(F.struct("o", block.alias("b"))))
    xml = F.concat(F.lit("<!DOCTYPE chapter [<!ENTITY x 'y'>]>\n<chapter>&nbsp;"), F.array_join(F.transform(parts, lambda p: p["b"]), ""), F.lit("</chapter>"))
    return _lines(s, d).groupBy(F.col("l_orderkey").alias("chapter")).agg(xml.alias("xml"))


_LINES = "l AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem), g AS (SELECT l_orderkey AS chapter, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'A') AS a FROM l GROUP BY 1)"


def _nodes(s, d):
    return M.node_table(_chapters(s, d))


def _fix(*names):
    return lambda s, d: M.fix_counts(M.rewrite(_chapters(s, d), fixes=list(names)))


def _count(fix, kind, expr):
    return f"SELECT '{fix}' AS fix, '{kind}' AS kind, CAST(sum({expr}) AS BIGINT) AS n FROM g HAVING sum({expr}) > 0"


def _fix_sql(*rows):
    return f"WITH {_LINES} " + " UNION ALL ".join(_count(*r) for r in rows)


def _books(s, d):
    """Books of the nations of a region, each nation a chapter."""
    n = table(s, d, "nation")
    chapter = F.concat(F.lit("<chapter><title>"), F.col("n_name"), F.lit("</title><para>x</para></chapter>"))
    parts = F.array_sort(F.collect_list(F.struct("n_nationkey", chapter.alias("c"))))
    return n.groupBy(F.col("n_regionkey").alias("book")).agg(F.concat(F.lit("<book><bookinfo><title>B</title><isbn>978</isbn></bookinfo>"), F.array_join(F.transform(parts, lambda p: p["c"]), ""), F.lit("</book>")).alias("xml"))


def _split(s, d):
    return M.split_chapters(_books(s, d))


# ---- references: resources are parts, uses are order lines, targets are missing for some ----
def _resources(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("resource"), F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("final_name"), (F.col("p_size") % 2 == 0).alias("is_vector")).filter("resource % 5 <> 0")


def _uses(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_partkey").alias("resource"))


def _placed(s, d):
    """Uses that place the resource in the text: lines of full quantity."""
    return table(s, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("chapter"), F.col("l_partkey").alias("resource"))


_RES = "res AS (SELECT p_partkey AS resource, concat('img', p_partkey, '.png') AS final_name, p_size % 2 = 0 AS is_vector FROM part WHERE p_partkey % 5 <> 0), uses AS (SELECT l_orderkey AS chapter, l_partkey AS resource FROM lineitem)"


def _figures(s, d):
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("As figure "), (F.col("p_partkey") % 50).cast("string"), F.lit(" shows, see Fig. 7.")).alias("text"))


def _labels(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("Figure "), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("resource"))


# ---- sources from files that the query writes first ----
def _written(spark, texts, name):
    """Rows of (file, text) as files below a fresh folder."""
    folder = scratch(spark)
    spark.createDataFrame(texts, "file string, value string").write.partitionBy("file").text(f"{folder}/{name}")
    return f"{folder}/{name}"


def _layout(s, d):
    """Fragments of all pages, written as layout XML and read again; a page is known by its document and number."""
    f = fragments(s, d)
    folder = scratch(s)
    text = F.struct(F.col("top").alias("_top"), F.col("left").alias("_left"), F.col("width").alias("_width"), F.col("height").alias("_height"), F.lit("F1").alias("_font"), F.concat(F.lit("t"), F.col("stream_index").cast("string")).alias("_VALUE"))
    pages = f.groupBy(F.col("doc_id").alias("_doc_id"), F.col("page").cast("int").alias("_number")).agg(F.lit(400.0).alias("_width"), F.lit(100.0).alias("_height"), F.collect_list(text).alias("text"))
    pages.write.format("xml").option("rootTag", "pdf2xml").option("rowTag", "page").save(f"{folder}/layout")
    return R.layout(s, f"{folder}/layout", "doc_id bigint").select("doc_id", "page", "text", "top", "left", "baseline")


def _media_path(s):
    xml = "<media_doc><page index='1'><media id='m1' type='raster' file='a.png' x1='1' y1='2' x2='3' y2='4'><caption>Fig 1</caption></media><media id='m2' type='raster' file='z.png' render_mode='fullpage'/></page><page index='2'><media id='m3' type='vector' file='c.svg' render_mode='fullpage'/><media id='m4' type='vector' file='b.svg' render_mode='fullpage'/></page></media_doc>"
    return _written(s, [("media", xml)], "media")


def _outlines(s, d):
    item = F.concat(F.lit('<item page="'), (F.col("l_linenumber") * 3).cast("string"), F.lit('">L'), F.col("l_linenumber").cast("string"), F.lit("</item>"))
    parts = F.array_sort(F.array_distinct(F.collect_list(F.struct("l_linenumber", item.alias("i")))))
    text = F.concat(F.lit("<outline>"), F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p["i"]).otherwise(F.concat(F.lit("<outline>"), p["i"], F.lit("</outline>")))), ""), F.lit("</outline>"))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(text.alias("text"))


def _sheet(s):
    rows = [["Filename", "Progress %", "Type"], ["a.pdf", "40", "PDF"], ["b.pdf", "100", "EPUB"]]
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f"<row r='{r + 1}'>" + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    data = K.package_bytes([("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Jobs" sheetId="1"/></sheets></workbook>'), ("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")])
    return s.createDataFrame([("jobs.xlsx", bytearray(data)), ("bad.xlsx", bytearray(b"no"))], "path string, content binary")


def _tables(s, d):
    row = F.concat(F.lit("<tr><th>N</th><th colspan='2'>B</th></tr><tr><td>"), F.col("p_name"), F.lit("</td><td>"), F.col("p_brand"), F.lit("</td><td>&amp;</td></tr>"))
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("<p>x</p><table>"), row, F.lit("</table>")).alias("html"))


def _markdown(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("# Top\n\n"), F.regexp_replace("text", "\n", "\n\n## Part\n\n"), F.lit("\n- a\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n")).alias("text"))


def _stream(s, d, closed=False):
    """The events table as a stream of files; ``closed`` adds a last file with an event far behind all others, which lets the watermark pass them."""
    folder, rows = scratch(s), table(s, d, "events")
    rows.repartition(4, "event_id").write.parquet(f"{folder}/events")
    if closed:
        last = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
        end = last.select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(None).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
        end.write.mode("append").parquet(f"{folder}/events")
    return folder, B.events(s, f"{folder}/events", 4)


def _replay(s, d):
    folder, stream = _stream(s, d)
    B.replay(stream, f"{folder}/state", B.upsert_into(f"{folder}/latest"))
    return B.current(s, f"{folder}/latest").select("user_id", "event_id", "event_type")


def _states(s, d):
    folder, stream = _stream(s, d)
    B.replay(stream, f"{folder}/state", B.states_into(f"{folder}/states"))
    return B.states(s, f"{folder}/states")


def _daily(s, d):
    folder, stream = _stream(s, d)
    return B.to_files(B.daily_counters(stream), folder, ["day", "event_type"])


def _sessions(s, d):
    folder, stream = _stream(s, d, closed=True)
    return B.append_files(B.sessions(stream), folder).filter("user_id IS NOT NULL")


def _outline_source(s, d):
    X.register_sources(s)
    return s.read.format("outline").option("text", "Preface 1\n  About 2\nChapter one 5\n").load()


def _conversion_rows(s, d):
    return conversions(s, d).select(F.concat("job_id", F.lit(".pdf")).alias("filename"), "created_at", "status", "duration_seconds", (F.col("duration_seconds") % 130).alias("progress"))


QUERIES = {
    "xml_01_nodes": lambda s, d: _nodes(s, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n")),
    "xml_02_kinds": lambda s, d: _nodes(s, d).groupBy(M.node_kind(F.col("tag")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "xml_04_bookinfo": lambda s, d: _books(s, d).select("book", M.book_info(F.col("xml")).alias("i")).select("book", "i.title", "i.isbn"),
    "xml_05_images": lambda s, d: M.images(table(s, d, "part").select("p_partkey", F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(F.col("p_partkey")), 8, "0")), F.unhex(F.lpad(F.hex(F.col("p_size").cast("bigint")), 8, "0"))).alias("content")), "p_partkey", "content"),
    "agg_23_elements": lambda s, d: M.element_counts(_nodes(s, d).withColumnRenamed("chapter", "book"), "book"),
    "join_05_links": lambda s, d: _chapters(s, d).select("chapter", F.size(M.dangling_targets(F.col("xml"))).cast("bigint").alias("n")).filter("n > 0"),
    "val_01_rules": lambda s, d: M.chapter_violations(_chapters(s, d)).groupBy("error_type").agg(F.count(F.lit(1)).alias("n")),
    "fix_01_titles": _fix("fix_01_titles"), "fix_03_figures": _fix("fix_03_figures"), "fix_04_levels": _fix("fix_04_levels"),
    "fix_06_paragraphs": _fix("fix_06_paragraphs"),
    "fix_10_empty": _fix("fix_10_empty"), "fix_11_attributes": _fix("fix_11_attributes"), "fix_12_ids": _fix("fix_04_levels", "fix_12_ids"), "fix_13_excluded": _fix("fix_13_excluded"),
    "fix_15_links": _fix("fix_15_links", "fix_15_sections"), "fix_18_chain": lambda s, d: M.fix_counts(M.rewrite(_chapters(s, d))),
    "fix_19_markdown": lambda s, d: M.node_table(M.from_markdown(_markdown(s, d), "doc_id", "text"), "doc_id").groupBy("tag").agg(F.count(F.lit(1)).alias("n")),
    "fix_20_blocks": lambda s, d: M.node_table(M.from_blocks(fragments(s, d).withColumn("label", F.when(F.col("stream_index") == 0, "chapter").when(F.col("bold"), "list_item").otherwise("para")), "doc_id", "stream_index"), "doc_id").groupBy("tag").agg(F.count(F.lit(1)).alias("n")),
    "fix_21_tables": lambda s, d: M.html_tables(_tables(s, d), "p_partkey", "html").groupBy("p_partkey").agg(F.sum(F.when(F.col("row") == 0, F.col("colspan"))).cast("bigint").alias("columns"), F.count_if(F.col("tag") == "th").alias("heads")),
    "src_21_html_tables": lambda s, d: M.html_tables(_tables(s, d), "p_partkey", "html").select("p_partkey", "row", "cell", "tag", "colspan", "text"),
    "fix_22_chapters": lambda s, d: _split(s, d).select("book", "n", "entity", "title"),
    "fix_22_toc": lambda s, d: M.toc(_split(s, d)),
    "ext_39_doctype": lambda s, d: _chapters(s, d).select("chapter", F.substring_index(M.doctype(F.col("xml"), "chapter", "c.dtd"), "<chapter>", 1).alias("head")),
    "ext_38_chapter_info": lambda s, d: _split(s, d).select("book", "entity", F.xpath_string("xml", F.lit("/chapter/title")).alias("title"), F.size(F.xpath("xml", F.lit("//para"))).alias("n_paras")),
    "join_01_names": lambda s, d: J.probe(_uses(s, d), _resources(s, d), "resource", "final_name"),
    "join_02_reverse": lambda s, d: J.probe(_resources(s, d).select("final_name"), _resources(s, d), "final_name", "resource"),
    "join_03_broken": lambda s, d: J.missing(_uses(s, d), _resources(s, d), ["resource"]),
    "join_04_unused": lambda s, d: J.missing(_resources(s, d), _placed(s, d), ["resource"]).select("resource"),
    "join_06_entities": lambda s, d: J.missing(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id"), ["doc_id"]),
    "join_07_figures": lambda s, d: J.mentions(_figures(s, d), _labels(s, d)).select("p_partkey", "mention", "resource"),
    "join_08_toc_pages": lambda s, d: table(s, d, "nation").select("n_name", (F.col("n_nationkey") % 4 + 1).cast("bigint").alias("page_num")).join(page_counts(s, d).select("page_num").distinct(), "page_num"),
    "join_23_fallbacks": lambda s, d: _fallbacks(s, d),
    "agg_24_report": lambda s, d: _resources(s, d).join(_uses(s, d).select("resource").distinct().withColumn("used", F.lit(1)), "resource", "left").agg(F.count(F.lit(1)).alias("resources"), F.count_if("is_vector").alias("vector"), F.count_if(~F.col("is_vector")).alias("raster"), F.count_if(F.col("used").isNull()).alias("unreferenced")),
    "agg_27_improvement": lambda s, d: M.fix_counts(M.rewrite(_chapters(s, d))).agg(F.sum("n").cast("bigint").alias("fixes")),
    "ext_26_registration": lambda s, d: T.upsert_latest(_uses(s, d).withColumn("path", F.col("resource") % 100), "path", [F.col("chapter"), F.col("resource")]).select("path", "chapter", "resource"),
    "ext_27_template": lambda s, d: table(s, d, "nation").select("n_nationkey", F.lit("Unknown").alias("template_type")),
    "ext_30_metadata_pick": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2), F.col("l_returnflag"))).alias("kind")),
    "ext_32_media_names": lambda s, d: K.media_names(table(s, d, "lineitem").select(F.concat(F.lit("ch"), F.col("l_orderkey").cast("string")).alias("chapter"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("place"), F.concat(F.lit("img"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("file")).distinct(), _resources(s, d).select(F.col("final_name").alias("file"))).select("chapter", "place", "name"),
    "ext_33_error_rows": lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("Element "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(": content model")).alias("m")).select("p_partkey", S.error_kind(F.col("m")).alias("error_type"), S.reference_error_kind(F.col("m")).alias("reference_type")),
    "ext_41_start_rows": lambda s, d: T.tracker_row(_conversion_rows(s, d)).select("filename", "start_time", "duration", "progress"),
    "src_05_spreadsheet": lambda s, d: R.records(R.sheet_cells(_sheet(s))).select("row", F.to_json("record").alias("record")),
    "src_12_layout": _layout,
    "src_13_media": lambda s, d: R.media(s, _media_path(s)).select("page", "id", "file", "caption", "x1"),
    "src_14_full_pages": lambda s, d: R.full_page_images(R.media(s, _media_path(s))),
    "src_15_metadata": lambda s, d: R.book_record(R.metadata_csv(s, _written(s, [("m", "Field,Value\nISBN,978-0-00\nTitle,A Book\nAuthor,Ann\nAuthor,\"Bob; Cy\"\nYear,2001\nCopyright,(c) 1999 X")], "csv"))).select("isbn", "title", F.array_join("authors", "|").alias("authors"), "pubdate", "copyright_year"),
    "src_17_onix": lambda s, d: R.onix(s, _written(s, [("o", "<ONIXMessage><Product><ProductIdentifier><ProductIDType>15</ProductIDType><IDValue>9781</IDValue></ProductIdentifier><DescriptiveDetail><TitleText>T</TitleText><Contributor><PersonName>A</PersonName></Contributor></DescriptiveDetail></Product></ONIXMessage>")], "onix") + "/*/*").select("isbn", "title", F.array_join("authors", "|").alias("authors")),
    "src_18_outline": lambda s, d: R.outline(_outlines(s, d), "l_orderkey", "text").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.max("level").alias("depth"), F.max("start_page").alias("last_page")),
    "src_19_entities": lambda s, d: R.entities(table(s, d, "nation").select("n_nationkey", F.concat(F.lit('<!DOCTYPE b [<!ENTITY ch1 SYSTEM "ch1.xml">\n<!ENTITY '), F.col("n_name"), F.lit(' SYSTEM "x.xml">]>')).alias("x")), "n_nationkey", "x").select("n_nationkey", "n", "entity", "system"),
    "src_20_packages": lambda s, d: R.packages(K.book_packages(_split(s, d)), "book", "package").groupBy("book").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.expr("error <> ''")).alias("errors")),
    "snk_01_tracker": lambda s, d: K.tracker_sheet(_conversion_rows(s, d)).select("filename", "status"),
    "snk_02_lines": lambda s, d: K.layout_sheets(fragments(s, d).withColumns({"block": F.lit(1), "col_id": F.col("stream_index") % 6, "baseline": F.col("top") + F.col("height")}))["Lines"].select("line", F.length("col4_text").alias("n")),
    "snk_04_validation": lambda s, d: K.validation_sheets(M.chapter_violations(_chapters(s, d)).withColumn("xml_file", F.concat(F.lit("c"), (F.col("chapter") % 10).cast("string"))))["Summary"],
    "snk_05_json": lambda s, d: K.complexity_json(T.complexity_report(T.page_complexity(page_counts(s, d))).select("doc_id", "pages", "ai_pages")),
    "snk_07_packages": lambda s, d: K.book_packages(_split(s, d)).select("book", "n_files"),
    "json_01_round_trip": lambda s, d: table(s, d, "nation").select("n_nationkey", F.from_json(F.to_json(F.struct("n_name", "n_regionkey")), "n_name string, n_regionkey int").alias("x")).select("n_nationkey", "x.n_name", "x.n_regionkey"),
    "arr_02_flatten": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_returnflag", "l_linestatus")).alias("a")).select("l_orderkey", F.size(F.flatten("a")).alias("n"), F.size(F.array_distinct(F.flatten("a"))).alias("kinds")),
    "sort_08_concat": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest")),
    "udf_01_source": _outline_source,
    "strm_01_states": _states,
    "strm_03_replay": _replay,
    "strm_04_daily": _daily,
    "strm_05_sessions": _sessions,
}


def _fallbacks(s, d):
    keyed = table(s, d, "part").select(F.col("p_partkey").alias("resource"))
    first = _resources(s, d).filter("is_vector").select(F.col("resource").alias("key1"), "final_name")
    second = table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("key2"), F.col("p_name").alias("other_name"))
    a = J.probe(keyed, first.withColumnRenamed("key1", "resource"), "resource", "final_name")
    return J.probe(a, second.withColumnRenamed("key2", "resource"), "resource", "other_name").select("resource", F.coalesce("final_name", "other_name").alias("found"))


#: Whether a block stands behind a section in a chapter.
_LATE = "(SELECT max(CASE WHEN l.l_returnflag <> 'N' AND EXISTS (SELECT 1 FROM l e WHERE e.l_orderkey = g.chapter AND e.l_returnflag = 'N' AND (e.l_linenumber, e.l_partkey, e.l_suppkey) < (l.l_linenumber, l.l_partkey, l.l_suppkey)) THEN 1 ELSE 0 END) FROM l WHERE l.l_orderkey = g.chapter)"
#: What the whole chain does to a chapter of r, n and a blocks.
_CHAIN_COUNTS = (
    ("fix_01_titles", "title", "1"), ("fix_03_figures", "imagedata", "a"), ("fix_04_levels", "section", "n"), ("fix_06_paragraphs", "nested para", "r"), ("fix_09_order", "order", "o"), ("fix_11_attributes", "fileref", "a"),
    ("fix_12_ids", "id", "n + 1"), ("fix_13_excluded", "remove", "a"), ("fix_13_excluded", "retag", "2 * a"), ("fix_14_space", "space", "r"), ("fix_15_links", "link", "a"),
)
ORACLE_SQL = {
    "xml_01_nodes": f"WITH {_LINES} SELECT * FROM (SELECT 'chapter' AS tag, count(*) AS n FROM g UNION ALL SELECT 'para', CAST(sum(2 * r + n) AS BIGINT) FROM g UNION ALL SELECT 'section', CAST(sum(n) AS BIGINT) FROM g UNION ALL SELECT 'title', CAST(sum(n) AS BIGINT) FROM g UNION ALL SELECT t, CAST(sum(a) AS BIGINT) FROM g, (VALUES ('p'), ('b'), ('br'), ('link'), ('imagedata')) v(t) GROUP BY 1) WHERE n > 0",
    "xml_02_kinds": f"WITH {_LINES} SELECT * FROM (SELECT 'chapter' AS kind, count(*) AS n FROM g UNION ALL SELECT 'block', CAST(sum(2 * r + 3 * n + 3 * a) AS BIGINT) FROM g UNION ALL SELECT 'inline', CAST(sum(a) AS BIGINT) FROM g UNION ALL SELECT 'media', CAST(sum(a) AS BIGINT) FROM g)",
    "xml_04_bookinfo": "SELECT DISTINCT n_regionkey AS book, 'B' AS title, '978' AS isbn FROM nation",
    "xml_05_images": "SELECT p_partkey, CAST(p_partkey AS INTEGER) AS width, CAST(p_size AS INTEGER) AS height, 'PNG' AS format FROM part",
    "agg_23_elements": f'WITH {_LINES} SELECT chapter AS book, CAST(1 AS BIGINT) AS chapter, a AS imagedata, 0 AS "table", 0 AS equation, n AS sections FROM g',
    "join_05_links": f"WITH {_LINES} SELECT chapter, a AS n FROM g WHERE a > 0",
    "val_01_rules": f"WITH {_LINES} SELECT * FROM (SELECT 'Invalid Content Model' AS error_type, count(*) AS n FROM g UNION ALL SELECT 'Missing Attribute', CAST(sum(a) AS BIGINT) FROM g UNION ALL SELECT 'Broken Link', CAST(sum(a) AS BIGINT) FROM g) WHERE n > 0",
    "fix_18_chain": f"WITH {_LINES}, t AS (SELECT g.*, {_LATE} AS o FROM g) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{fix}' AS fix, '{kind}' AS kind, CAST(sum({n}) AS BIGINT) AS n FROM t" for fix, kind, n in _CHAIN_COUNTS) + ") WHERE n > 0",
    "agg_27_improvement": f"WITH {_LINES}, t AS (SELECT g.*, {_LATE} AS o FROM g) SELECT CAST(sum({' + '.join(n for *_, n in _CHAIN_COUNTS)}) AS BIGINT) AS fixes FROM t",
    "fix_01_titles": f"WITH {_LINES} SELECT 'fix_01_titles' AS fix, 'title' AS kind, count(*) AS n FROM g",
    "fix_03_figures": _fix_sql(("fix_03_figures", "imagedata", "a")),
    "fix_04_levels": _fix_sql(("fix_04_levels", "section", "n")),
    "fix_06_paragraphs": _fix_sql(("fix_06_paragraphs", "nested para", "r")),
    "fix_10_empty": _fix_sql(("fix_10_empty", "empty", "a")),
    "fix_11_attributes": _fix_sql(("fix_11_attributes", "fileref", "a")),
    "fix_12_ids": _fix_sql(("fix_04_levels", "section", "n"), ("fix_12_ids", "id", "n + 1")),
    "fix_13_excluded": _fix_sql(("fix_13_excluded", "retag", "2 * a"), ("fix_13_excluded", "remove", "a")),
    "fix_15_links": _fix_sql(("fix_15_links", "link", "a")),
    "fix_21_tables": "SELECT p_partkey, CAST(3 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS heads FROM part",
    "fix_20_blocks": "WITH f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), b AS (SELECT *, CASE WHEN i = 0 THEN 'c' WHEN length(t) % 2 = 0 THEN 'l' ELSE 'p' END AS k FROM f) SELECT * FROM (SELECT 'chapter' AS tag, count(DISTINCT doc_id) AS n FROM b UNION ALL SELECT 'bridgehead', count(*) FROM b WHERE k = 'c' UNION ALL SELECT 'para', count(*) FROM b WHERE k <> 'c' UNION ALL SELECT 'itemizedlist', count(*) FROM b WHERE k = 'l' UNION ALL SELECT 'listitem', count(*) FROM b WHERE k = 'l') WHERE n > 0",
    "src_21_html_tables": "SELECT p_partkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS cell, CASE r WHEN 0 THEN 'th' ELSE 'td' END AS tag, CASE WHEN r = 0 AND c = 1 THEN 2 ELSE 1 END AS colspan, CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'N' ELSE 'B' END WHEN c = 0 THEN p_name WHEN c = 1 THEN p_brand ELSE '&' END AS text FROM part, (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (1, 2)) v(r, c)",
    "fix_22_chapters": "SELECT n_regionkey AS book, CAST(row_number() OVER w - 1 AS INTEGER) AS n, concat('ch', lpad(CAST(row_number() OVER w AS VARCHAR), 4, '0')) AS entity, n_name AS title FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)",
    "fix_22_toc": "WITH c AS (SELECT n_regionkey AS book, n_nationkey AS o, concat('<tocentry linkend=\"ch', lpad(CAST(row_number() OVER w AS VARCHAR), 4, '0'), '\">', n_name, '</tocentry>') AS e FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) SELECT book, concat('<toc><title>Table of Contents</title>', string_agg(e, '' ORDER BY o), '</toc>') AS toc FROM c GROUP BY 1",
    "ext_39_doctype": "SELECT DISTINCT l_orderkey AS chapter, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<!DOCTYPE chapter SYSTEM \"c.dtd\">', chr(10)) AS head FROM lineitem",
    "ext_38_chapter_info": "SELECT n_regionkey AS book, concat('ch', lpad(CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR), 4, '0')) AS entity, n_name AS title, 1 AS n_paras FROM nation",
    "join_01_names": f"WITH {_RES} SELECT uses.resource, chapter, final_name FROM uses LEFT JOIN res USING (resource)",
    "join_02_reverse": f"WITH {_RES} SELECT final_name, resource FROM res",
    "join_03_broken": f"WITH {_RES} SELECT resource, chapter FROM uses WHERE resource NOT IN (SELECT resource FROM res)",
    "join_04_unused": f"WITH {_RES} SELECT resource FROM res WHERE resource NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "join_06_entities": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "join_07_figures": "SELECT p_partkey, mention, n_name AS resource FROM (SELECT p_partkey, concat('figure ', p_partkey % 50) AS mention, p_partkey % 50 AS k FROM part UNION ALL SELECT p_partkey, 'Fig. 7', 7 FROM part) LEFT JOIN nation ON n_nationkey = k",
    "join_08_toc_pages": "SELECT n_name, CAST(n_nationkey % 4 + 1 AS BIGINT) AS page_num FROM nation WHERE n_nationkey % 4 + 1 IN (SELECT l_linenumber FROM lineitem)",
    "join_23_fallbacks": f"WITH {_RES} SELECT p_partkey AS resource, coalesce(CASE WHEN is_vector THEN final_name END, CASE WHEN p_size > 10 THEN p_name END) AS found FROM part LEFT JOIN res ON p_partkey = resource",
    "agg_24_report": f"WITH {_RES} SELECT count(*) AS resources, count(*) FILTER (is_vector) AS vector, count(*) FILTER (NOT is_vector) AS raster, count(*) FILTER (resource NOT IN (SELECT resource FROM uses)) AS unreferenced FROM res",
    "ext_26_registration": f"WITH {_RES} SELECT resource % 100 AS path, chapter, resource FROM uses QUALIFY row_number() OVER (PARTITION BY resource % 100 ORDER BY chapter DESC, resource DESC) = 1",
    "ext_27_template": "SELECT n_nationkey, 'Unknown' AS template_type FROM nation",
    "ext_30_metadata_pick": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' ELSE 'N' END AS kind FROM lineitem GROUP BY 1",
    "ext_32_media_names": f"WITH {_RES}, u AS (SELECT DISTINCT concat('ch', l_orderkey) AS chapter, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS place, concat('img', l_partkey, '.png') AS file FROM lineitem), n AS (SELECT chapter, place, concat(chapter, 'f', lpad(CAST(row_number() OVER (PARTITION BY chapter ORDER BY place) AS VARCHAR), 2, '0'), '.png') AS name FROM u WHERE file IN (SELECT final_name FROM res)) SELECT u.chapter, u.place, name FROM u LEFT JOIN n USING (chapter, place)",
    "ext_33_error_rows": "SELECT p_partkey, 'Invalid Content Model' AS error_type, 'Reference Error' AS reference_type FROM part",
    "ext_41_start_rows": f"WITH {CONVERSIONS_SQL} SELECT concat(job_id, '.pdf') AS filename, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS start_time, CASE WHEN coalesce(duration_seconds, 0) = 0 THEN 'N/A' ELSE concat(duration_seconds, 's') END AS duration, greatest(0, least(100, duration_seconds % 130)) AS progress FROM conv",
    "src_13_media": "SELECT * FROM (VALUES (1, 'm1', 'a.png', 'Fig 1', 1.0), (1, 'm2', 'z.png', NULL, NULL), (2, 'm3', 'c.svg', NULL, NULL), (2, 'm4', 'b.svg', NULL, NULL)) v(page, id, file, caption, x1)",
    "src_14_full_pages": "SELECT * FROM (VALUES (1, 'z.png'), (2, 'b.svg')) v(page, file)",
    "src_15_metadata": "SELECT '978000' AS isbn, 'A Book' AS title, 'Ann|Bob|Cy' AS authors, '2001' AS pubdate, '1999' AS copyright_year",
    "src_17_onix": "SELECT '9781' AS isbn, 'T' AS title, 'A' AS authors",
    "src_18_outline": "SELECT l_orderkey, count(DISTINCT l_linenumber) AS items, CASE WHEN count(DISTINCT l_linenumber) > 1 THEN 2 ELSE 1 END AS depth, max(l_linenumber) * 3 - 1 AS last_page FROM lineitem GROUP BY 1",
    "src_19_entities": "SELECT n_nationkey, n, entity, system FROM (SELECT n_nationkey, 0 AS n, 'ch1' AS entity, 'ch1.xml' AS system FROM nation UNION ALL SELECT n_nationkey, 1, n_name, 'x.xml' FROM nation)",
    "src_20_packages": "SELECT n_regionkey AS book, count(*) + 1 AS entries, CAST(0 AS BIGINT) AS errors FROM nation GROUP BY 1",
    "src_05_spreadsheet": """SELECT * FROM (VALUES (1, '{"filename":"a.pdf","progress":"40","type":"PDF"}'), (2, '{"filename":"b.pdf","progress":"100","type":"EPUB"}')) v(row, record)""",
    "snk_01_tracker": f"WITH {CONVERSIONS_SQL} SELECT concat(job_id, '.pdf') AS filename, status FROM conv",
    "snk_05_json": "SELECT l_orderkey AS doc_id, concat('{\"pages\":', count(*), ',\"ai_pages\":', count(*) FILTER (l_partkey % 3 > 0 OR l_suppkey % 2 > 0), '}') AS json FROM lineitem GROUP BY 1",
    "snk_07_packages": "SELECT n_regionkey AS book, CAST(count(*) + 1 AS INTEGER) AS n_files FROM nation GROUP BY 1",
    "json_01_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "arr_02_flatten": "SELECT l_orderkey, CAST(2 * count(*) AS INTEGER) AS n, CAST((SELECT count(DISTINCT x) FROM (SELECT l_returnflag AS x FROM lineitem i WHERE i.l_orderkey = o.l_orderkey UNION ALL SELECT l_linestatus FROM lineitem i WHERE i.l_orderkey = o.l_orderkey)) AS INTEGER) AS kinds FROM lineitem o GROUP BY 1",
    "sort_08_concat": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "udf_01_source": "SELECT * FROM (VALUES (0, 1, 'Preface', 1), (1, 2, 'About', 2), (2, 1, 'Chapter one', 5)) v(seq, level, title, page)",
    "strm_01_states": "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS state, arg_max(greatest(0, least(100, value)), struct_pack(a := ts, b := event_id)) AS progress, max(ts) FILTER (event_type = 'purchase') AS completed_at, count(*) AS n FROM events GROUP BY 1",
    "strm_03_replay": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "strm_04_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "strm_05_sessions": "WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM b) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k",
}
