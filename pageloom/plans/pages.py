"""Queries over page kinds, drawings, media order, scripts, compositions and the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import word_splits as V
from ..operators import detection as D
from ..operators import kernels as K
from ..operators import markup as M
from ..operators import pages as P
from ..operators import tracking as T
from ..sources import readers as R
from ..sources import writers as O
from . import documents as Q
from . import layout as L
from .adapters import BOXES_SQL, FRAGMENTS_SQL, PAGES_SQL, boxes, page_counts, table

c = F.col


def _line_counts(s, d):
    """Shapes of pages: an order is a page, its lines are drawings."""
    li = table(s, d, "lineitem")
    return li.groupBy(c("l_orderkey").alias("page")).agg(
        F.count_if(c("l_returnflag") == "R").alias("curves"), F.count_if(c("l_returnflag") == "N").alias("lines"), F.count_if(c("l_returnflag") == "A").alias("quads"), F.count_if(c("l_linestatus") == "O").alias("rects"),
        F.sum(c("l_quantity").cast("bigint")).alias("small"), (F.sum(c("l_partkey")) % 900).cast("bigint").alias("chars"), F.count(F.lit(1)).alias("n"),
    )


_SHAPES = """sh AS (SELECT l_orderkey AS page, count(*) FILTER (l_returnflag = 'R') AS curves, count(*) FILTER (l_returnflag = 'N') AS lines, count(*) FILTER (l_returnflag = 'A') AS quads, count(*) FILTER (l_linestatus = 'O') AS rects,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS small, CAST(sum(l_partkey) % 900 AS BIGINT) AS chars, count(*) AS n FROM lineitem GROUP BY 1)"""

SPLITS = ("man- agement", "elec-tromagnetic", "high-quality", "Com pany.", "an ordinary sentence", "compu-\ntation", "two  words", "weal th and heal th")


def _marked(s, d):
    """A markup tree of two pages for each nation."""
    xml = F.concat(F.lit("<book><chapter id='page_3'><para>a</para><sect1 page='7'><para>b</para></sect1></chapter><para>"), c("n_name"), F.lit("</para></book>"))
    return M.node_table(table(s, d, "nation").select(c("n_nationkey").alias("book"), xml.alias("xml")), "book")


def _figures(s, d):
    xml = F.concat(F.lit("<chapter><figure><title>T"), c("n_nationkey").cast("string"), F.lit("</title>"), F.when(c("n_nationkey") % 2 == 0, "<caption>C</caption>").otherwise(""), F.lit("<mediaobject/></figure></chapter>"))
    return M.node_table(table(s, d, "nation").select(c("n_nationkey").alias("book"), xml.alias("xml")), "book")


def _labels_of(s, d):
    return L._frag(s, d).select("doc_id", "page", "top", F.when(c("font_size") >= 15, "chapter").otherwise("para").alias("label"), "text")


def _marks_of(s, d):
    """Outlines with an entry for the back matter; others do not replace what was found."""
    marks = L._marks(s, d)
    return marks.join(marks.filter("title = 'Index'").select("doc_id").distinct(), "doc_id", "left_semi")


QUERIES = {
    "str_07_word_splits": lambda s, d: table(s, d, "part").select("p_partkey", V.repair(F.element_at(F.array(*map(F.lit, SPLITS)), (c("p_partkey") % len(SPLITS) + 1).cast("int"))).alias("text")),
    "str_28_segments": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_returnflag"))), lambda x: x["l_returnflag"]), " ").alias("text")),
    "flt_18_forms": lambda s, d: _line_counts(s, d).select("page", P.is_form(c("small") % 14, c("curves") * 6, c("lines") * 15, c("rects") / 7.0, c("chars")).alias("form"), P.is_cover(c("n"), F.lit(7)).alias("cover")),
    "flt_18_cover_reasons": lambda s, d: _line_counts(s, d).select("page", P.cover_reason(c("n"), F.lit(7), c("chars"), c("rects") / 7.0).alias("reason")),
    "ext_06_shapes": lambda s, d: _line_counts(s, d).select("page", P.has_shapes(c("curves"), c("lines"), c("quads"), c("rects")).alias("shapes")),
    "ext_07_table_drawings": lambda s, d: _line_counts(s, d).select("page", P.is_table_drawing(c("curves"), c("lines"), c("rects")).alias("table_drawing")),
    "ext_14_routes": lambda s, d: _line_counts(s, d).select("page", P.extraction_route(c("n"), F.lit(7), c("chars") < 30, c("chars") > 870, c("curves"), c("lines"), c("quads")).alias("route")),
    "win_33_element_pages": lambda s, d: P.element_pages(_marked(s, d), "book").select("book", "node_id", "tag", "page"),
    "win_35_media_order": lambda s, d: P.media_order(boxes(s, d).select("page", "box", c("y0").alias("y"), F.when(c("kind") == "R", c("box") % 50).alias("caption_order"))).select("page", "box", "reading_order"),
    "win_36_scripts": lambda s, d: P.mark_scripts(L._frag(s, d).withColumn("page", F.concat_ws("-", "doc_id", "page")).withColumn("text", c("font_size").cast("string")).withColumn("width", c("width") % 20), ["page", "stream_index"]),
    "win_11_columns": L._group(lambda p: [K.column_id(a, w, L.PAGE_W, [0.0, 150.0, 300.0]) for a, w in zip(p.left, p.width, strict=True)]),
    "win_10_starts": L._group(lambda p: [float(len(K.column_starts(list(zip(p.baseline, p.left, p.width, strict=True)), L.PAGE_W)))] * len(p), kind="double"),
    "ext_04_line_tables": lambda s, d: P.line_cluster_tables(L._rules(s, d)).select("page", "x0", "x1", "y0", "y1"),
    "ext_05_analysis": lambda s, d: P.analyse_pages(page_counts(s, d)).select("doc_id", "pages", "ai_pages", "avg_score"),
    "ext_09_trim": lambda s, d: P.trimmed_tables(*L._pair(s, d)).select("page", "box", "y0", "y1"),
    "ext_12_spans": lambda s, d: boxes(s, d).select("page", "box", "x0", "y0", "x1", "y1"),
    "ext_13_panels": lambda s, d: P.panel_groups(L._components(s, d).join(boxes(s, d).distinct(), ["page", "box"])),
    "ext_15_keywords": lambda s, d: table(s, d, "documents").select("doc_id", (F.regexp_count("text", F.lit(r"(?i)\btable\s+[0-9]")) > 0).alias("has_table_word"), (F.regexp_count("text", F.lit(r"\|")) >= 4).alias("ruled")),
    "ext_17_lines": lambda s, d: P.built_lines(L._frag(s, d).select("doc_id", "page", "stream_index", "text", "top", "left", "height", "font_size"), ["doc_id", "page"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("font_size").alias("largest")),
    "ext_19_chapters": lambda s, d: P.with_bookmark_chapters(_labels_of(s, d), _marks_of(s, d)).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")),
    "ext_21_cells": lambda s, d: M.html_tables(Q._tables(s, d), "p_partkey", "html").groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell", "text"))), lambda x: x["text"]), " ").alias("text")),
    "ext_22_segments": lambda s, d: P.format_runs(L._frag(s, d), ["doc_id"], "stream_index").groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").cast("bigint").alias("fragments")),
    "ext_23_flow": lambda s, d: table(s, d, "part").select("p_partkey", P.flow_index(F.when(c("p_partkey") % 3 == 0, "x").otherwise(F.lit(None)), F.when(c("p_partkey") % 2 == 0, c("p_size").cast("string"))).alias("flow")),
    "ext_24_preprocess": lambda s, d: P.preprocess(L._frag(s, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(c("offset") + c("top")).alias("lowest")),
    "ext_25_registered": lambda s, d: P.registered_media(Q._uses(s, d), Q._resources(s, d)).select("resource", F.size("referenced_in").alias("n"), "first_chapter"),
    "ext_29_links": lambda s, d: P.linked_text(Q._figures(s, d), Q._labels(s, d), "p_partkey"),
    "ext_31_captions": lambda s, d: P.image_captions(_figures(s, d), "book").select("book", "caption"),
    "ext_34_clean": lambda s, d: M.rewrite(Q._books(s, d), "book", fixes=["fix_14_space"]).select("book", F.size("fixes").alias("fixes")),
    "ext_35_files": lambda s, d: M.rewrite(Q._chapters(s, d)).groupBy((c("chapter") % 10).alias("book")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.size("fixes") > 0).alias("changed")),
    "ext_36_plain_pages": lambda s, d: P.page_results(table(s, d, "conversations").select("conv_id", "turn", F.when(c("turn") % 3 == 0, "").otherwise(c("text")).alias("content"))).select("conv_id", "turn", "success", "error"),
    "ext_37_confidence": lambda s, d: table(s, d, "part").select("p_partkey", P.table_confidence(F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("<!-- confidence: 0."), (c("p_partkey") % 9).cast("string"), F.lit(" -->")))).alias("confidence")),
    "ext_40_packaging": lambda s, d: R.packages(O.book_packages(M.split_chapters(Q._books(s, d))), "book", "package").filter("entry LIKE '%.xml'").groupBy("book").agg(F.count(F.lit(1)).alias("chapters")),
    "src_08_save": lambda s, d: _saved(s, d),
    "src_11_files": lambda s, d: R.stored_files(s, Q._written(s, [("9780", "x"), ("9781", "y")], "store")).select("isbn", "file_type").distinct(),
    "snk_03_catalogue": lambda s, d: _catalogue(s, d),
    "snk_06_mapper": lambda s, d: Q._resources(s, d).select("resource", F.from_json(F.to_json(F.struct("final_name", "is_vector")), "final_name string, is_vector boolean").alias("x")).select("resource", "x.final_name", "x.is_vector"),
    "arr_01_distinct": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_returnflag"))), lambda x: x["l_returnflag"])), "").alias("kinds")),
    "set_04_texts": lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("kinds")),
    "sort_05_reading": lambda s, d: L._frag(s, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("baseline", "left", "stream_index"))), lambda x: x["stream_index"].cast("string")), ",").alias("order")),
    "sort_06_columns": lambda s, d: L._frag(s, d).withColumn("k", F.when((c("col_id") == 0) & (c("top") < 150), -1).when(c("col_id") == 0, 99).otherwise(c("col_id"))).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "top", "stream_index"))), lambda x: x["stream_index"].cast("string")), ",").alias("order")),
    "sort_07_sizes": lambda s, d: D.font_statistics(L._frag(s, d), "doc_id", "stream_index").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("font_size", "n")), asc=False), lambda x: x["font_size"].cast("string")), ",").alias("sizes")),
    "strm_02_progress": lambda s, d: T.upsert_latest(table(s, d, "events").select("user_id", T.clamp_percent(c("value")).alias("progress"), "ts", "event_id"), "user_id", [c("ts"), c("event_id")]).select("user_id", "progress"),
    "xml_03_edits": lambda s, d: M.fix_counts(M.rewrite(table(s, d, "nation").select(c("n_nationkey").alias("chapter"), F.lit("<chapter><para>a<para>b</para>c</para><imagedata/><div><script/>x</div></chapter>").alias("xml")), fixes=["fix_13_excluded", "fix_03_figures", "fix_06_paragraphs", "fix_08_media"])),
    "agg_15_families": lambda s, d: table(s, d, "part").groupBy(F.lower(F.substring_index("p_type", " ", 1)).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("first")),
}


def _saved(s, d):
    folder = Q.scratch(s)
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.json(f"{folder}/jobs")
    return s.read.schema("o_orderkey bigint, o_orderstatus string").json(f"{folder}/jobs")


def _catalogue(s, d):
    folder = Q.scratch(s)
    rows = Q._resources(s, d).select(
        c("final_name").alias("filename"), c("final_name").alias("original_name"), F.lit("ch1").alias("chapter"), c("resource").alias("figure_number"), F.lit("c").alias("caption"), F.lit("a").alias("alt_text"),
        F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("1B").alias("size"), F.lit("PNG").alias("format"),
    )
    O.write_catalogue(O.image_catalogue(rows), folder)
    return s.read.format("xml").option("rowTag", "image").schema("filename string, figure_number bigint").load(f"{folder}/catalogue")


_FRAG = L._FRAG
ORACLE_SQL = {
    "str_07_word_splits": "SELECT p_partkey, list_element(['management', 'electromagnetic', 'high-quality', 'Company.', 'an ordinary sentence', 'compu-tation', 'twowords', 'wealth and health'], CAST(p_partkey % 8 + 1 AS INTEGER)) AS text FROM part",
    "str_28_segments": "SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_partkey, l_suppkey, l_returnflag) AS text FROM lineitem GROUP BY 1",
    "flt_18_forms": f"WITH {_SHAPES}, x AS (SELECT page, n, chars, small % 14 AS s, curves * 6 AS cu, lines * 15 AS li, rects / 7.0 AS de FROM sh) SELECT page, chars < 500 AND (s >= 10 OR (cu >= 20 AND s >= 5) OR (li >= 50 AND s >= 5) OR (de >= 0.3 AND (cu >= 10 OR s >= 8))) AS form, n IN (1, 7) AS cover FROM x",
    "flt_18_cover_reasons": f"WITH {_SHAPES}, x AS (SELECT page, n, concat_ws('; ', CASE WHEN chars < 200 THEN 'minimal text' END, CASE WHEN rects / 7.0 > 0.5 THEN 'high image coverage' END, CASE WHEN rects / 7.0 > 0.6 THEN 'large cover image' END) AS w FROM sh) SELECT page, CASE WHEN n = 1 THEN concat('Front cover: ', CASE WHEN w <> '' THEN w ELSE 'first page' END) WHEN n = 7 THEN concat('Back cover: ', CASE WHEN w <> '' THEN w ELSE 'last page' END) END AS reason FROM x",
    "ext_06_shapes": f"WITH {_SHAPES} SELECT page, curves >= 1 OR (lines >= 3 AND rects <= 2) OR quads >= 2 AS shapes FROM sh",
    "ext_07_table_drawings": f"WITH {_SHAPES} SELECT page, curves < 3 AND ((lines >= 3 AND rects >= 3) OR (lines >= 5 AND rects >= 2) OR (lines >= 2 AND rects >= 5)) AS table_drawing FROM sh",
    "ext_14_routes": f"WITH {_SHAPES} SELECT page, CASE WHEN n IN (1, 7) THEN 'cover' WHEN chars < 30 OR chars > 870 THEN 'full_page' WHEN curves > 0 THEN 'raster' WHEN lines > 0 THEN 'table' WHEN quads > 0 THEN 'vector' ELSE 'text' END AS route FROM sh",
    "win_33_element_pages": "SELECT n_nationkey AS book, i AS node_id, t AS tag, p AS page FROM nation, (VALUES (0, 'book', NULL), (1, 'chapter', 3), (2, 'para', 3), (3, 'sect1', 7), (4, 'para', 7), (5, 'para', NULL)) v(i, t, p)",
    "win_35_media_order": f"WITH {BOXES_SQL} SELECT page, box, CAST(CASE WHEN kind = 'R' THEN box % 50 + 0.5 ELSE y0 END AS DOUBLE) AS reading_order FROM boxes",
    "win_11_columns": f"""WITH {FRAGMENTS_SQL} SELECT doc_id, page, stream_index, text, top, "left", width, height, font_size, bold, top + height AS baseline, CAST(stream_index % 3 AS BIGINT) AS col_id, CAST(stream_index // 5 AS BIGINT) AS block,
      CAST(CASE WHEN "left" <= 20 AND "left" + width >= 380 THEN 0 WHEN abs("left" + width / 2.0 - 200) <= 60 AND (NOT (abs("left") <= 20 OR abs("left" - 150) <= 20 OR abs("left" - 300) <= 20) OR width >= 120) THEN 0 ELSE 1 + CASE WHEN "left" >= 75 THEN 1 ELSE 0 END + CASE WHEN "left" >= 225 THEN 1 ELSE 0 END END AS BIGINT) AS grp FROM frag""",
    "ext_05_analysis": f"WITH {PAGES_SQL} SELECT doc_id, count(*) AS pages, count(*) FILTER (table_count > 0 OR image_count > 0) AS ai_pages, round_even(sum(CASE WHEN table_count > 0 THEN 5 ELSE 0 END + CASE WHEN image_count > 0 THEN 4 ELSE 0 END) / CAST(count(*) AS DOUBLE), 3) AS avg_score FROM pc GROUP BY 1",
    "ext_12_spans": f"WITH {BOXES_SQL} SELECT page, box, x0, y0, x1, y1 FROM boxes",
    "ext_15_keywords": "SELECT doc_id, regexp_matches(text, '(?i)\\btable\\s+[0-9]') AS has_table_word, length(text) - length(replace(text, '|', '')) >= 4 AS ruled FROM documents",
    "ext_19_chapters": f"WITH {_FRAG}, {L._MARKS}, o AS (SELECT DISTINCT doc_id FROM m WHERE title = 'Index'), l AS (SELECT doc_id, CASE WHEN font_size >= 15 THEN 'chapter' ELSE 'para' END AS label FROM f), u AS (SELECT doc_id, label FROM l WHERE label <> 'chapter' OR doc_id NOT IN (SELECT doc_id FROM o) UNION ALL SELECT doc_id, 'chapter' FROM m WHERE doc_id IN (SELECT doc_id FROM o) AND level = 1) SELECT doc_id, label, count(*) AS n FROM u GROUP BY 1, 2",
    "ext_21_cells": "SELECT p_partkey, concat('N B ', p_name, ' ', p_brand, ' &') AS text FROM part",
    "ext_23_flow": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS DOUBLE) AS flow FROM part",
    "ext_25_registered": f"WITH {Q._RES} SELECT res.resource, CAST(count(DISTINCT chapter) AS INTEGER) AS n, min(chapter) AS first_chapter FROM res LEFT JOIN uses ON uses.resource = res.resource GROUP BY 1",
    "ext_29_links": "SELECT p_partkey, concat('As ', CASE WHEN p_partkey % 50 IN (SELECT n_nationkey FROM nation) THEN concat('<link linkend=\"', (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 50), '\">figure ', p_partkey % 50, '</link>') ELSE concat('figure ', p_partkey % 50) END, ' shows, see <link linkend=\"', (SELECT n_name FROM nation WHERE n_nationkey = 7), '\">Fig. 7</link>.') AS text FROM part",
    "ext_31_captions": "SELECT n_nationkey AS book, CASE WHEN n_nationkey % 2 = 0 THEN 'C' ELSE concat('T', n_nationkey) END AS caption FROM nation",
    "ext_34_clean": "SELECT DISTINCT n_regionkey AS book, 0 AS fixes FROM nation",
    "ext_35_files": "SELECT l_orderkey % 10 AS book, count(DISTINCT l_orderkey) AS files, count(DISTINCT l_orderkey) AS changed FROM lineitem GROUP BY 1",
    "ext_36_plain_pages": "SELECT conv_id, turn, turn % 3 <> 0 AND trim(text) <> '' AS success, CASE WHEN NOT (turn % 3 <> 0 AND trim(text) <> '') THEN 'no content' END AS error FROM conversations",
    "ext_37_confidence": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 9) / 10.0 ELSE 0.9 END AS confidence FROM part",
    "ext_40_packaging": "SELECT n_regionkey AS book, count(*) AS chapters FROM nation GROUP BY 1",
    "src_08_save": "SELECT o_orderkey, o_orderstatus FROM orders",
    "snk_03_catalogue": f"WITH {Q._RES} SELECT final_name AS filename, resource AS figure_number FROM res",
    "snk_06_mapper": f"WITH {Q._RES} SELECT resource, final_name, is_vector FROM res",
    "set_04_texts": "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1",
    "sort_05_reading": f"""WITH {_FRAG} SELECT doc_id, page, string_agg(CAST(stream_index AS VARCHAR), ',' ORDER BY baseline, "left", stream_index) AS "order" FROM f GROUP BY 1, 2""",
    "sort_06_columns": f"""WITH {_FRAG} SELECT doc_id, page, string_agg(CAST(stream_index AS VARCHAR), ',' ORDER BY CASE WHEN col_id = 0 AND top < 150 THEN -1 WHEN col_id = 0 THEN 99 ELSE col_id END, top, stream_index) AS "order" FROM f GROUP BY 1, 2""",
    "sort_07_sizes": f"WITH {_FRAG}, z AS (SELECT doc_id, font_size FROM f WHERE font_size >= 4 AND trim(text) <> '' GROUP BY 1, 2) SELECT doc_id, string_agg(CAST(font_size AS VARCHAR), ',' ORDER BY font_size DESC) AS sizes FROM z GROUP BY 1",
    "strm_02_progress": "SELECT user_id, greatest(0, least(100, value)) AS progress FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "agg_15_families": "SELECT lower(split_part(p_type, ' ', 1)) AS family, count(*) AS n, arg_min(p_partkey, struct_pack(a := p_size, b := p_partkey)) AS first FROM part GROUP BY 1",
}
