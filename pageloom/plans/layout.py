"""Queries over fragments, rectangles, page lines and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection as D
from ..operators import joins as J
from ..operators import kernels as K
from ..operators import windows as N
from .adapters import BOXES_SQL, FRAGMENTS_SQL, boxes, fragments, table

PAGE_W, PAGE_H = 400.0, 100.0
KEYS = ["doc_id", "page"]


def _frag(s, d):
    """Fragments with the further columns that some operators read; the baseline is the line's bottom."""
    f = fragments(s, d)
    return f.withColumns({
        "baseline": F.col("top") + F.col("height"), "col_id": (F.col("stream_index") % 3).cast("bigint"), "block": F.floor(F.col("stream_index") / 5).cast("bigint"),
        "page_height": F.lit(PAGE_H), "page_width": F.lit(PAGE_W), "page_num": F.col("page") + 1,
    })


_FRAG = FRAGMENTS_SQL + f""",
f AS (SELECT *, top + height AS baseline, CAST(stream_index % 3 AS BIGINT) AS col_id, CAST(stream_index // 5 AS BIGINT) AS block, {PAGE_H} AS page_height, {PAGE_W} AS page_width, page + 1 AS page_num FROM frag)"""


def _pair(s, d):
    b = boxes(s, d)
    return b.filter("kind = 'R'"), b.filter("kind = 'N'")


_AB = BOXES_SQL + """, a AS (SELECT * FROM boxes WHERE kind = 'R'), b AS (SELECT * FROM boxes WHERE kind = 'N')"""
_HIT = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"


def _marks(s, d):
    """An outline of each order: its lines in order, levels one to three, starting on ever later pages."""
    li = table(s, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"), (F.when(F.col("l_linenumber") == 1, 1).otherwise(F.col("l_partkey") % 3 + 1)).cast("bigint").alias("level"),
        (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 5).cast("bigint").alias("start_page"), F.lit(100).cast("bigint").alias("total_pages"),
        F.when(F.col("l_linenumber") == 1, "Preface").when(F.col("l_returnflag") == "R", "Index").otherwise("Chapter x").alias("title"),
    ).distinct()


_MARKS = """m AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE l_partkey % 3 + 1 END AS BIGINT) AS level,
  CAST(l_linenumber * 10 + l_suppkey % 5 AS BIGINT) AS start_page, CAST(100 AS BIGINT) AS total_pages,
  CASE WHEN l_linenumber = 1 THEN 'Preface' WHEN l_returnflag = 'R' THEN 'Index' ELSE 'Chapter x' END AS title FROM lineitem)"""
_ENDS = _MARKS + """, e AS (SELECT m.*, greatest(m.start_page, coalesce((SELECT n.start_page FROM m n WHERE n.doc_id = m.doc_id AND n.seq > m.seq AND n.level <= m.level ORDER BY n.seq LIMIT 1) - 1, m.total_pages - 1)) AS end_page FROM m)"""


def _pages(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*(F.lit(x).cast("bigint") for x in (5, 14, 33, 72)))).alias("page"))


_PAGES = "pages_of AS (SELECT o_orderkey AS doc_id, CAST(unnest([5, 14, 33, 72]) AS BIGINT) AS page FROM orders)"


def _rules(s, d):
    """Rules of a page: each order's lines as horizontal and vertical rules."""
    li = table(s, d, "lineitem")
    page = F.floor(F.col("l_orderkey") / 8).cast("bigint")
    h = li.select(page.alias("page"), F.lit("h").alias("kind"), (F.col("l_partkey") % 9).cast("bigint").alias("start"), (F.lit(150) + F.col("l_suppkey") % 90).cast("bigint").alias("end"), (F.col("l_linenumber") * 20).cast("bigint").alias("pos"))
    v = li.select(page.alias("page"), F.lit("v").alias("kind"), (F.col("l_suppkey") % 9).cast("bigint").alias("start"), (F.lit(90) + F.col("l_partkey") % 60).cast("bigint").alias("end"), (F.col("l_linenumber") * 25).cast("bigint").alias("pos"))
    return h.unionByName(v)


def _cells(s, d):
    """Cells of tables: an order is a table, a line a row, three columns."""
    li = table(s, d, "lineitem")
    text = F.when(F.col("c") == 0, F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_orderkey") % 4 == 0, ". x").otherwise("x"))).when(F.col("c") == 1, F.col("l_returnflag")).otherwise(F.when(F.col("l_partkey") % 2 == 0, F.col("l_linestatus")).otherwise(""))
    rows = li.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("row"), F.col("c").cast("bigint").alias("col"), text.alias("text"))


_CELLS = """cells AS (SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS BIGINT) AS row, CAST(c AS BIGINT) AS col,
  CASE c WHEN 0 THEN concat(l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN '. x' ELSE 'x' END) WHEN 1 THEN l_returnflag ELSE CASE WHEN l_partkey % 2 = 0 THEN l_linestatus ELSE '' END END AS text
  FROM lineitem, (VALUES (0), (1), (2)) v(c))"""


def _tables(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("table_id"), (F.col("o_custkey") % 100).cast("bigint").alias("accuracy"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.col("o_orderkey") % 300).cast("bigint").alias("x1"), F.lit(60).alias("y1"))


def _talk(s, d):
    return table(s, d, "conversations")


def _nearest_sql(extra: str, distance: str) -> str:
    return f"""WITH {_AB}, n AS (SELECT a.page, a.box, CAST({distance} AS DOUBLE) AS distance, b.box AS b_box FROM a JOIN b ON a.page = b.page WHERE {extra}),
      k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY distance, b_box) = 1)
      SELECT a.page, a.box, k.distance, k.b_box FROM a LEFT JOIN k ON a.page = k.page AND a.box = k.box"""


_GAP = "CASE WHEN b.y1 <= a.y0 THEN a.y0 - b.y1 WHEN b.y0 >= a.y1 THEN b.y0 - a.y1 END"
_CENTRE = "sqrt(power((a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0, 2) + power((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0, 2))"


def _nearest(s, d, condition, distance):
    a, b = _pair(s, d)
    return J.nearest(a, b, ["page", "box"], "page", condition, distance, ["box"]).select("page", "box", F.col("distance").cast("double").alias("distance"), "b_box")


def _group(kernel, order=("top", "stream_index"), keys=KEYS, out="grp", kind="bigint"):
    return lambda s, d: K.per_group(_frag(s, d).select("doc_id", "page", "stream_index", "text", "top", "left", "width", "height", "font_size", "bold", "baseline", "col_id", "block"), list(keys), list(order), out, kind, kernel)


def _column_ids(p):
    starts = K.column_starts(list(zip(p.baseline, p.left, p.width, strict=True)), PAGE_W)
    return [K.column_id(a, w, PAGE_W, starts) for a, w in zip(p.left, p.width, strict=True)]


def _first_column(s, d):
    a, b = _pair(s, d)
    return J.first_cell(a, b, ["page", "box"], "box").select("page", "box", "cell")


def _components(s, d):
    """Panels of a page that hang together; pages are small, so each is one group."""
    b = boxes(s, d).distinct()

    def kernel(p):
        rows = list(zip(p.x0, p.y0, p.x1, p.y1, strict=True))
        edges = []
        for i, a in enumerate(rows):
            for j in range(i):
                c = rows[j]
                beside = min(a[3], c[3]) > max(a[1], c[1]) and max(a[0], c[0]) - min(a[2], c[2]) <= 20
                above = min(a[2], c[2]) > max(a[0], c[0]) and max(a[1], c[1]) - min(a[3], c[3]) <= 20
                if beside or above:
                    edges.append((i, j))
        return [int(p.box[r]) for r in K.components(len(rows), edges)]

    return K.per_group(b, ["page"], ["box"], "component", "bigint", kernel).select("page", "box", "component").distinct()


def _rect_groups(kernel):
    return lambda s, d: K.per_group(boxes(s, d), ["page"], ["box"], "grp", "bigint", lambda p: kernel(list(zip(p.x0, p.y0, p.x1, p.y1, strict=True)))).select("page", "box", "grp")


def _labels(s, d):
    f = _frag(s, d)
    heading = F.when(F.col("font_size") >= 15, F.when(F.col("stream_index") % 7 == 0, "toc").when(F.col("stream_index") % 5 == 0, "chapter").otherwise("section"))
    rows = f.select("doc_id", "stream_index", "text", "font_size", F.when(F.col("n_chars") % 31 == 0, "table").otherwise("line").alias("kind"), heading.alias("heading"), (F.col("n_chars") < 3).alias("is_noise"), (F.col("n_chars") % 11 == 0).alias("is_list"), (F.col("page") % 2 == 0).alias("in_outline"))
    return K.per_group(rows, ["doc_id"], ["stream_index"], "label", "string", lambda p: K.block_labels(p.records())).select("doc_id", "stream_index", "label")


QUERIES = {
    "math_01_overlap": lambda s, d: J.overlapping(*_pair(s, d)).select("page", "box", "b_box", G.overlap_area(G.sides(), G.sides("b_")).cast("bigint").alias("shared"), F.round(G.iou(G.sides(), G.sides("b_")), 6).alias("iou")),
    "math_03_dpi": lambda s, d: table(s, d, "part").select("p_partkey", G.suggested_dpi(F.col("p_size") * 20, F.col("p_partkey")).alias("dpi")),
    "math_04_statistics": lambda s, d: _frag(s, d).groupBy("doc_id").agg(F.median("width").alias("middle"), F.round(F.stddev_samp("width"), 6).alias("deviation"), F.element_at(F.array_sort(F.collect_list("width")), (F.floor(F.count(F.lit(1)) * 0.75) + 1).cast("int")).alias("upper")),
    "ext_11_flip": lambda s, d: boxes(s, d).select("page", "box", *(c.cast("bigint").alias(n) for c, n in zip(G.flip(G.sides(), F.lit(800)), G.SIDES, strict=True))),
    "join_09_spans": lambda s, d: J.overlapping(*_pair(s, d)).select("page", "box", "b_box"),
    "join_10_iou": lambda s, d: J.without_overlap(*_pair(s, d), 0.15, 0.2).select("page", "box"),
    "join_11_cells": _first_column,
    "join_12_captions": lambda s, d: _nearest(s, d, *J.caption_gap(60)),
    "join_13_centres": lambda s, d: _nearest(s, d, *J.centre_distance(200)),
    "join_14_keywords": lambda s, d: J.near_keyword(*_pair(s, d)).select("page", "box"),
    "join_15_ordinals": lambda s, d: J.caption_of_media(_talk(s, d).filter("role = 'user'").select(F.col("conv_id").alias("block"), F.col("turn").alias("ordinal")), _talk(s, d).filter("role <> 'user'").select(F.col("conv_id").alias("block"), F.col("turn").alias("ordinal"))),
    "join_16_scripts": lambda s, d: J.script_parents(_frag(s, d).withColumn("page", F.concat_ws("-", "doc_id", "page")).withColumn("text", F.col("font_size").cast("string")).withColumn("width", F.col("width") % 20), ["page", "stream_index"]),
    "join_17_panels": lambda s, d: J.panel_edges(boxes(s, d)),
    "join_18_boundary": lambda s, d: J.boundary_above(boxes(s, d).select("page", "box", F.col("y0").alias("y")), boxes(s, d).select("page", F.col("y1").alias("y"))).select("page", "box", "boundary"),
    "join_19_bookmark": lambda s, d: J.active_bookmark(_pages(s, d), N.bookmark_ends(_marks(s, d))),
    "join_20_starts": lambda s, d: J.bookmarks_at(_pages(s, d), _marks(s, d)).select("doc_id", "page", F.array_join(F.transform("marks", lambda m: m["seq"].cast("string")), ",").alias("marks")),
    "join_21_text_media": lambda s, d: _pair(s, d)[0].groupBy("page").agg(F.count(F.lit(1)).alias("texts")).join(_pair(s, d)[1].groupBy("page").agg(F.count(F.lit(1)).alias("media")), "page", "full").select("page", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("media", F.lit(0)).alias("media")),
    "join_22_columns": lambda s, d: boxes(s, d).select("page", "box", J.nearest_column(F.col("x0"), F.array(F.lit(40), F.lit(180), F.lit(330))).cast("bigint").alias("column_index")),
    "flt_04_noise": lambda s, d: _frag(s, d).select("doc_id", "stream_index", D.is_noise(F.col("text"), F.col("top"), F.col("height"), F.col("page_height"), F.col("n_chars") % 5 == 0).alias("noise")),
    "flt_05_footers": lambda s, d: D.is_footer_line(_frag(s, d), "doc_id", "stream_index").select("doc_id", "stream_index", "is_footer"),
    "flt_06_spines": lambda s, d: _frag(s, d).select("doc_id", "stream_index", D.is_spine(F.col("font_size").cast("string"), F.col("left") * 8, F.col("width") % 9, F.col("height"), F.lit(PAGE_W), F.lit(0)).alias("spine")),
    "flt_07_content": lambda s, d: boxes(s, d).select("page", "box", (G.share_inside(G.sides(), (F.lit(50), F.lit(50), F.lit(350), F.lit(500))) >= 0.5).alias("inside")),
    "flt_08_images": lambda s, d: boxes(s, d).select("page", "box", D.is_significant_image(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(612 * 792)).alias("significant")),
    "flt_09_image_kinds": lambda s, d: boxes(s, d).select("page", "box", D.image_kind(F.col("kind") == "A", (F.col("x1") - F.col("x0")) * 4, (F.col("y1") - F.col("y0")) * 8, F.col("box") % 7 * 30).alias("image_kind")),
    "flt_14_scripts": lambda s, d: _frag(s, d).select("doc_id", "stream_index", D.is_script(F.concat((F.col("n_chars") % 200).cast("string"), F.when(F.col("bold"), "^").otherwise("")), F.col("width") % 20, F.col("height")).alias("script")),
    "flt_15_tables": lambda s, d: D.real_tables(_cells(s, d), _tables(s, d)).select("table_id", "is_table"),
    "flt_16_text_heavy": lambda s, d: J.overlapping(*_pair(s, d)).groupBy("page", "box").agg(((F.count(F.lit(1)) > 4) | (F.sum(G.overlap_area(G.sides(), G.sides("b_"))) / F.max(G.area(G.sides())) > 0.5)).alias("heavy")),
    "flt_17_references": lambda s, d: D.reference_pages(_frag(s, d), KEYS, ["top", "left", "stream_index"]),
    "flt_18_rtl": lambda s, d: table(s, d, "documents").select("doc_id", D.right_to_left(F.col("text")).alias("rtl")),
    "flt_19_zones": lambda s, d: J.outside_zones(*_pair(s, d)).select("page", "box"),
    "agg_13_fonts": lambda s, d: D.font_statistics(_frag(s, d), "doc_id", "stream_index").select("doc_id", "font_size", "n", "pages", "body_size", "role"),
    "agg_14_roles": lambda s, d: table(s, d, "part").select("p_partkey", D.font_role_by_ratio(F.col("p_size") / 30.0).alias("role")),
    "agg_15_sizes": lambda s, d: D.font_statistics(_frag(s, d), "doc_id", "stream_index").groupBy("role").agg(F.sum("n").cast("bigint").alias("n"), F.min_by("doc_id", F.struct("doc_id", F.col("font_size"))).alias("first_doc")),
    "agg_16_tiers": lambda s, d: D.role_tiers(D.font_statistics(_frag(s, d), "doc_id", "stream_index"), "doc_id").select("doc_id", "font_size", "tier"),
    "agg_17_repeated": lambda s, d: D.repeated_at_position(_frag(s, d).withColumn("text", F.concat(F.lit("Running header "), F.col("page").cast("string"))), "doc_id"),
    "agg_18_headers": lambda s, d: D.repeated_headers(_frag(s, d).withColumn("text", F.concat(F.lit("header "), (F.col("stream_index") % 2).cast("string"))), "doc_id", _frag(s, d).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))),
    "agg_19_sequences": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(D.sequential(F.collect_set(F.concat(F.when(F.col("l_orderkey") % 3 == 0, "chapter ").otherwise("page "), (F.col("l_linenumber") * (F.col("l_orderkey") % 5 + 1)).cast("string")))).alias("sequential")),
    "agg_20_lines": lambda s, d: D.line_pivot(table(s, d, "lineitem").select(F.col("l_orderkey").alias("line"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("l_linenumber"), (F.col("l_partkey") % 7 - 1).alias("col_id"), F.col("l_returnflag").alias("text")), ["line"], "l_linenumber"),
    "agg_21_columns": lambda s, d: D.column_bounds(_frag(s, d), "doc_id", "col_id", PAGE_W),
    "agg_22_body": lambda s, d: D.body_size(_frag(s, d), "doc_id"),
    "agg_25_grids": lambda s, d: D.ruled_tables(_rules(s, d)),
    "agg_26_structure": lambda s, d: D.structure_box(boxes(s, d), ["page"]),
    "agg_28_overlap": lambda s, d: D.column_overlap(_frag(s, d), ["doc_id"], "col_id"),
    "win_01_tolerance": lambda s, d: N.baseline_tolerance(_frag(s, d), KEYS, "baseline", "stream_index"),
    "win_04_islands": lambda s, d: N.islands(table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], F.col("t"), "event_id", 6 * 3600 * 1_000_000).select("user_id", "event_id", "island"),
    "win_07_mean": lambda s, d: N.mean_baseline(_frag(s, d), ["doc_id", "page", "col_id"], "baseline").select("doc_id", "stream_index", "norm_baseline"),
    "win_15_breaks": lambda s, d: N.paragraph_breaks(_frag(s, d), ["doc_id"], ["stream_index"]).select("doc_id", "stream_index", "breaks", "paragraph"),
    "win_16_continues": lambda s, d: N.continues_word(_frag(s, d).withColumn("baseline", F.lit(0)).withColumn("col_id", F.lit(1)), ["doc_id"], ["stream_index"]).select("doc_id", "stream_index", "continues"),
    "win_17_pages": lambda s, d: N.page_merges(_frag(s, d), "doc_id", "page", "baseline").select("doc_id", "page", "merges"),
    "win_18_ends": lambda s, d: N.bookmark_ends(_marks(s, d)).select("doc_id", "seq", "start_page", "end_page"),
    "win_19_bounds": lambda s, d: N.matter_bounds(_marks(s, d)),
    "win_20_levels": lambda s, d: N.heading_levels(_frag(s, d), "doc_id", "font_size").select("doc_id", "stream_index", "level"),
    "win_23_runs": lambda s, d: N.runs(_talk(s, d), ["conv_id"], "turn", ["role"]).select("conv_id", "run", "role", "n", "first", F.sha2("text", 256).alias("digest")),
    "win_24_global": lambda s, d: N.global_tops(_frag(s, d), "doc_id", "page", "page_height").select("doc_id", "stream_index", (F.col("offset") + F.col("top")).alias("global_top")),
    "win_25_duplicates": lambda s, d: N.drop_duplicates(_frag(s, d).select("doc_id", "page", "top", "left", "width", "height", "text", "stream_index"), ["doc_id", "page", "left", "text"], "stream_index").select("doc_id", "page", "stream_index"),
    "win_26_hashes": lambda s, d: N.content_names(table(s, d, "documents"), F.col("text"), "doc_id", "doc_id").select("doc_id", "sha256", "kept_name"),
    "win_27_ids": lambda s, d: N.unique_ids(table(s, d, "customer").withColumn("base", F.concat_ws("-", "c_mktsegment", F.lit("section"))), ["c_nationkey"], "base", "c_custkey").select("c_custkey", "unique_id"),
    "win_28_lists": lambda s, d: N.confirmed_lists(_frag(s, d).withColumn("kind", F.when(F.col("n_chars") % 3 == 0, "ordered").when(F.col("n_chars") % 3 == 1, "itemized")), KEYS, "stream_index", "kind").select("doc_id", "stream_index", "confirmed"),
    "win_31_header_row": lambda s, d: D.header_row(_cells(s, d), ["table_id"]),
    "win_32_page_numbers": lambda s, d: N.page_numbers(_frag(s, d).withColumn("text", F.when(F.col("n_chars") % 2 == 0, (F.col("n_chars") % 500).cast("string")).otherwise("word")), KEYS, PAGE_H, 30.0),
    "tree_01_parents": lambda s, d: N.parents(_marks(s, d)).select("doc_id", "seq", "parent_seq"),
    "tree_02_flat": lambda s, d: _marks(s, d).select("doc_id", "seq", F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.col("title")).alias("line")),
    "ext_01_metrics": lambda s, d: D.text_metrics(_frag(s, d), KEYS, PAGE_W * PAGE_H, PAGE_H).select("doc_id", "page", "blocks", "chars", "has_header_footer"),
    "ext_02_drawings": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(D.complex_drawings(F.col("l_partkey") % 3, F.col("l_suppkey") % 2 == 0, F.col("l_quantity"))).alias("n")),
    "ext_03_aligned": lambda s, d: D.aligned_text_table(_frag(s, d), KEYS),
    "ext_08_expand": lambda s, d: J.within_page(*_pair(s, d), "page", lambda r, c: G.distance_to(r, *G.centre(c)) <= 50).groupBy("page", "box").agg(F.min(F.least("x0", "b_x0")).alias("x0"), F.min(F.least("y0", "b_y0")).alias("y0"), F.max(F.greatest("x1", "b_x1")).alias("x1"), F.max(F.greatest("y1", "b_y1")).alias("y1")),
    "ext_10_links": lambda s, d: J.overlapping(*_pair(s, d)).groupBy("page", "box").agg(F.count(F.lit(1)).alias("links")),
    "ext_16_toc": lambda s, d: D.toc_span(_frag(s, d).withColumn("text", F.when(F.col("stream_index") == 2, "Contents").otherwise(F.col("text"))), "doc_id", "stream_index").select("doc_id", "stream_index"),
    "ext_18_titles": lambda s, d: D.chapter_titles(_frag(s, d), "doc_id", "stream_index").select("doc_id", "size", F.sha2("title", 256).alias("digest")),
    "ext_20_boundaries": lambda s, d: N.paragraph_boundaries(_frag(s, d).withColumn("top", F.col("top") * 4), KEYS, "stream_index"),
    "ext_28_rows": lambda s, d: J.first_cell(*_pair(s, d), ["page", "box"], "box").filter("cell IS NOT NULL").select("page", "box"),
    "win_02_lines": _group(lambda p: K.running_mean_groups(list(p.baseline), 5.0), ("baseline", "stream_index")),
    "win_03_anchored": _group(lambda p: K.anchored_groups(list(p.baseline), 5.0), ("baseline", "stream_index")),
    "win_05_column_count": _group(lambda p: [K.column_count(list(p.left), PAGE_W)] * len(p)),
    "win_06_bins": _group(lambda p: K.online_bins(list(p.left), [max(1, w) for w in p.width], 25.0), ("stream_index",)),
    "win_08_gap": _group(lambda p: [K.gap_threshold([float(x) for x in p.left if x > 0], float(p.width.mean()), PAGE_W)] * len(p), kind="double"),
    "win_09_columns": _group(_column_ids),
    "win_12_repair": _group(lambda p: K.repair_columns(list(p.col_id), list(p.baseline), 5.0), ("baseline", "stream_index")),
    "win_13_blocks": _group(lambda p: K.reading_blocks(list(p.baseline), list(p.col_id)), ("baseline", "stream_index")),
    "win_14_inline": _group(lambda p: K.inline_runs(list(zip(p.text, p.left, p.width, p.height, strict=True)), set(N.CONTINUES)), ("left", "stream_index")),
    "win_15_paragraphs": _group(lambda p: K.paragraph_groups(p.records()), ("stream_index",), ("doc_id",)),
    "win_21_tables": lambda s, d: K.per_group(_frag(s, d).select("doc_id", "page", "stream_index", "n_chars"), ["doc_id"], ["stream_index"], "merged", "boolean", lambda p: K.table_chains(list(zip(p.page, p.n_chars % 4, p.n_chars % 9 == 0, strict=True)))),
    "win_22_list_levels": lambda s, d: K.per_group(_frag(s, d).select("doc_id", "page", "stream_index", "n_chars"), ["doc_id"], ["stream_index"], "level", "bigint", lambda p: K.list_levels(list(p.n_chars % 9), list(p.page))),
    "win_29_headings": _group(lambda p: K.heading_lines(list(p.font_size)), ("stream_index",)),
    "win_30_tables": _group(lambda p: K.aligned_tables([(t, h, [0.0, float(a)]) for t, h, a in zip(p.top, p.height, p.left, strict=True)]), ("top", "stream_index")),
    "win_34_labels": _labels,
    "graph_01_components": _components,
    "graph_02_merge": _rect_groups(K.merged_rects),
    "graph_03_cover": _rect_groups(K.covered_rects),
}
ORACLE_SQL = {
    "math_01_overlap": f"WITH {_AB} SELECT a.page, a.box, b.box AS b_box, CAST({_SHARED} AS BIGINT) AS shared, round(CAST({_SHARED} AS DOUBLE) / ({_AREA.format('a')} + {_AREA.format('b')} - {_SHARED}), 6) AS iou FROM a JOIN b ON a.page = b.page AND {_HIT}",
    "math_03_dpi": "SELECT p_partkey, CASE WHEN m(200) <= 4000 THEN 200 WHEN m(150) <= 4000 THEN 150 ELSE 100 END AS dpi FROM part".replace("m(200)", "(p_size * 20 * 5 + 612 / 72.0 * 200 * (792 / 72.0 * 200) * 3 / 1048576 * 1.5 + p_partkey * 2 + 200)").replace("m(150)", "(p_size * 20 * 5 + 612 / 72.0 * 150 * (792 / 72.0 * 150) * 3 / 1048576 * 1.5 + p_partkey * 2 + 200)"),
    "math_04_statistics": f"WITH {_FRAG} SELECT doc_id, median(width) AS middle, round(stddev_samp(width), 6) AS deviation, list_element(list(width ORDER BY width), CAST(floor(count(*) * 0.75) AS BIGINT) + 1) AS upper FROM f GROUP BY 1",
    "ext_11_flip": f"WITH {BOXES_SQL} SELECT page, box, x0, 800 - y1 AS y0, x1, 800 - y0 AS y1 FROM boxes",
    "join_09_spans": f"WITH {_AB} SELECT a.page, a.box, b.box AS b_box FROM a JOIN b ON a.page = b.page AND {_HIT}",
    "join_10_iou": f"WITH {_AB} SELECT page, box FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND (CAST({_SHARED} AS DOUBLE) / ({_AREA.format('a')} + {_AREA.format('b')} - {_SHARED}) > 0.15 OR CAST({_SHARED} AS DOUBLE) / ({_AREA.format('a')}) > 0.2))",
    "join_11_cells": f"WITH {_AB} SELECT a.page, a.box, min(b.box) AS cell FROM a LEFT JOIN b ON a.page = b.page AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 AND b.y1 GROUP BY 1, 2",
    "join_12_captions": _nearest_sql(f"b.x0 < a.x1 AND a.x0 < b.x1 AND {_GAP} <= 60", _GAP),
    "join_13_centres": _nearest_sql(f"{_CENTRE} <= 200", _CENTRE),
    "join_14_keywords": f"WITH {_AB} SELECT page, box FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND b.y0 <= a.y1 + 100 AND b.y1 >= a.y0 - 100 AND b.x0 <= a.x1 + 50 AND b.x1 >= a.x0 - 50)",
    "join_15_ordinals": "SELECT p.conv_id AS block, p.turn AS ordinal, m.turn AS media FROM conversations p JOIN conversations m ON p.conv_id = m.conv_id AND p.role = 'user' AND m.role <> 'user' AND p.turn - m.turn BETWEEN -2 AND 3 AND p.turn <> m.turn QUALIFY row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY abs(p.turn - m.turn), m.turn) = 1",
    "join_17_panels": f"""WITH {BOXES_SQL} SELECT a.page, a.box AS u, b.box AS v, CASE WHEN least(a.y1, b.y1) > greatest(a.y0, b.y0) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 20 THEN 'horizontal' ELSE 'vertical' END AS direction
      FROM boxes a JOIN boxes b ON a.page = b.page AND a.box < b.box AND ((least(a.y1, b.y1) > greatest(a.y0, b.y0) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 20) OR (least(a.x1, b.x1) > greatest(a.x0, b.x0) AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 20))""",
    "join_18_boundary": f"WITH {BOXES_SQL} SELECT a.page, a.box, CAST(coalesce((SELECT max(b.y1) FROM boxes b WHERE b.page = a.page AND b.y1 < a.y0), a.y0) AS DOUBLE) AS boundary FROM boxes a",
    "join_19_bookmark": f"WITH {_ENDS}, {_PAGES} SELECT p.doc_id, p.page, (SELECT e.seq FROM e WHERE e.doc_id = p.doc_id AND p.page BETWEEN e.start_page AND e.end_page ORDER BY e.level DESC, e.seq LIMIT 1) AS bookmark FROM pages_of p",
    "join_20_starts": f"WITH {_MARKS}, {_PAGES} SELECT p.doc_id, p.page, string_agg(CAST(m.seq AS VARCHAR), ',' ORDER BY m.level, m.seq) AS marks FROM pages_of p LEFT JOIN m ON m.doc_id = p.doc_id AND m.start_page + 1 = p.page GROUP BY 1, 2",
    "join_21_text_media": f"WITH {BOXES_SQL} SELECT page, count(*) FILTER (kind = 'R') AS texts, count(*) FILTER (kind = 'N') AS media FROM boxes WHERE kind IN ('R', 'N') GROUP BY 1",
    "join_22_columns": f"WITH {BOXES_SQL} SELECT page, box, CAST(CASE WHEN least(abs(x0 - 40), abs(x0 - 180), abs(x0 - 330)) > 50 THEN NULL WHEN abs(x0 - 40) <= least(abs(x0 - 180), abs(x0 - 330)) THEN 0 WHEN abs(x0 - 180) <= abs(x0 - 330) THEN 1 ELSE 2 END AS BIGINT) AS column_index FROM boxes",
    "flt_07_content": f"WITH {BOXES_SQL} SELECT page, box, CAST(greatest(least(x1, 350) - greatest(x0, 50), 0) * greatest(least(y1, 500) - greatest(y0, 50), 0) AS DOUBLE) / ((x1 - x0) * (y1 - y0)) >= 0.5 AS inside FROM boxes",
    "flt_08_images": f"WITH {BOXES_SQL} SELECT page, box, (x1 - x0 >= 50 AND y1 - y0 >= 50) OR (x1 - x0) * (y1 - y0) >= 0.01 * 612 * 792 AS significant FROM boxes",
    "flt_09_image_kinds": f"WITH {BOXES_SQL}, i AS (SELECT *, (x1 - x0) * 4 AS w, (y1 - y0) * 8 AS h FROM boxes) SELECT page, box, CASE WHEN kind = 'A' THEN 'content' WHEN (w > 500 AND h > 700 AND h / CAST(w AS DOUBLE) > 1.1 AND h / CAST(w AS DOUBLE) < 1.5) OR box % 7 * 30 < 100 THEN 'decorative' ELSE 'content' END AS image_kind FROM i",
    "flt_14_scripts": f"WITH {_FRAG} SELECT doc_id, stream_index, width % 20 < 15 AND height < 14 AND length(CAST(n_chars % 200 AS VARCHAR)) + CASE WHEN bold THEN 1 ELSE 0 END <= 3 AS script FROM f",
    "flt_15_tables": f"""WITH {_CELLS}, g AS (SELECT table_id, max(row) + 1 AS nr, count(*) FILTER (trim(text) <> '') AS filled, count(*) AS n, count(*) FILTER (col = 0 AND text LIKE '%. x') AS listed, count(*) FILTER (col = 0) AS firsts FROM cells GROUP BY 1)
      SELECT o_orderkey AS table_id, coalesce(o_custkey % 100 >= 60 AND nr >= 2 AND (o_orderkey % 300) * 60 >= 5000 AND filled >= 0.1 * n AND listed <= 0.7 * firsts, false) AS is_table FROM orders LEFT JOIN g ON table_id = o_orderkey""",
    "flt_16_text_heavy": f"WITH {_AB} SELECT a.page, a.box, count(*) > 4 OR CAST(sum({_SHARED}) AS DOUBLE) / max({_AREA.format('a')}) > 0.5 AS heavy FROM a JOIN b ON a.page = b.page AND {_HIT} GROUP BY 1, 2",
    "flt_17_references": f"""WITH {_FRAG}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, "left", stream_index) AS n FROM f),
      g AS (SELECT doc_id, page, bool_or(n <= 10 AND regexp_matches(lower(trim(text)), 'contents|index|glossary|references|appendix')) AS k, bool_or(n <= 10 AND regexp_matches(lower(trim(text)), 'contents|glossary|appendix')) AS s, count(*) FILTER (length(trim(text)) >= 3) AS l, count(*) FILTER (length(trim(text)) >= 3 AND regexp_matches(trim(text), '[\\s.,]+[0-9]{{1,4}}\\s*$')) AS m FROM r GROUP BY 1, 2)
      SELECT doc_id, page, (k AND CASE WHEN l >= 3 THEN m / CAST(l AS DOUBLE) ELSE 0 END > 0.1) OR CASE WHEN l >= 3 THEN m / CAST(l AS DOUBLE) ELSE 0 END > 0.5 OR s AS is_reference FROM g""",
    "flt_19_zones": f"WITH {_AB} SELECT page, box FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 AND b.y1)",
    "agg_13_fonts": f"""WITH {_FRAG}, z AS (SELECT doc_id, font_size, count(*) AS n, count(DISTINCT page) AS pages, min(stream_index) AS first FROM f WHERE font_size >= 4 AND trim(text) <> '' GROUP BY 1, 2), y AS (SELECT doc_id, font_size AS body_size FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)
      SELECT doc_id, font_size, n, pages, body_size, CASE WHEN font_size / CAST(body_size AS DOUBLE) >= 1.5 THEN 'title' WHEN font_size / CAST(body_size AS DOUBLE) >= 1.3 THEN 'chapter' WHEN font_size / CAST(body_size AS DOUBLE) >= 1.15 THEN 'section' WHEN font_size / CAST(body_size AS DOUBLE) >= 1.05 THEN 'subsection' ELSE 'body' END AS role FROM z JOIN y USING (doc_id)""",
    "agg_14_roles": "SELECT p_partkey, CASE WHEN p_size / 30.0 >= 1.5 THEN 'title' WHEN p_size / 30.0 >= 1.3 THEN 'chapter' WHEN p_size / 30.0 >= 1.15 THEN 'section' WHEN p_size / 30.0 >= 1.05 THEN 'subsection' ELSE 'body' END AS role FROM part",
    "agg_19_sequences": "SELECT l_orderkey, count(DISTINCT l_linenumber) >= 2 AND l_orderkey % 3 <> 0 AS sequential FROM lineitem GROUP BY 1",
    "agg_20_lines": """WITH l AS (SELECT l_orderkey AS line, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS n, l_partkey % 7 - 1 AS c, l_returnflag AS t FROM lineitem), g AS (SELECT line, CASE WHEN c > 4 OR c < 0 THEN 4 ELSE c END AS b, c, string_agg(t, ' ' ORDER BY n) AS t FROM l GROUP BY 1, 2, 3)
      SELECT line, coalesce(string_agg(t, ' | ' ORDER BY c) FILTER (b = 0), '') AS col0_text, coalesce(string_agg(t, ' | ' ORDER BY c) FILTER (b = 1), '') AS col1_text, coalesce(string_agg(t, ' | ' ORDER BY c) FILTER (b = 2), '') AS col2_text, coalesce(string_agg(t, ' | ' ORDER BY c) FILTER (b = 3), '') AS col3_text, coalesce(string_agg(t, ' | ' ORDER BY c) FILTER (b = 4), '') AS col4_text FROM g GROUP BY 1""",
    "agg_21_columns": f"""WITH {_FRAG}, g AS (SELECT doc_id, col_id, CASE WHEN col_id = 0 THEN 0.0 ELSE median("left") END AS l, CASE WHEN col_id = 0 THEN {PAGE_W} ELSE median("left" + width) END AS r FROM f GROUP BY 1, 2) SELECT doc_id, col_id, CAST(l AS DOUBLE) AS left_start, CAST(r AS DOUBLE) AS right_end, CAST(least(0.1 * (r - l), 20) AS DOUBLE) AS tolerance FROM g""",
    "agg_22_body": f"WITH {_FRAG} SELECT doc_id, CAST(coalesce(median(font_size) FILTER (length(text) >= 30), median(font_size), 12) AS DOUBLE) AS body_size FROM f GROUP BY 1",
    "agg_26_structure": f"WITH {BOXES_SQL} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY 1 HAVING count(*) >= 3",
    "agg_28_overlap": f"""WITH {_FRAG}, h AS (SELECT doc_id, col_id, min(top) AS a, max(top + height) AS b FROM f GROUP BY 1, 2), w AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY col_id) AS c, lead(b) OVER (PARTITION BY doc_id ORDER BY col_id) AS d FROM h) SELECT doc_id, col_id, least(b, d) - greatest(a, c) > 0.25 * ((b - a) + (d - c)) AS overlap FROM w WHERE c IS NOT NULL""",
    "win_01_tolerance": f"WITH {_FRAG}, g AS (SELECT doc_id, page, baseline - lag(baseline) OVER (PARTITION BY doc_id, page ORDER BY baseline, stream_index) AS s FROM f) SELECT doc_id, page, CAST(greatest(4, coalesce(median(s) FILTER (s > 0) * 0.5, 4)) AS DOUBLE) AS tolerance FROM g GROUP BY 1, 2",
    "win_04_islands": "SELECT user_id, event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)",
    "win_07_mean": f"WITH {_FRAG} SELECT doc_id, stream_index, round_even(avg(baseline) OVER (PARTITION BY doc_id, page, col_id), 1) AS norm_baseline FROM f",
    "win_15_breaks": f"WITH {_FRAG}, b AS (SELECT *, coalesce(lag(col_id) OVER w <> col_id OR lag(block) OVER w <> block OR top - (lag(top) OVER w + lag(height) OVER w) > 3, true) AS breaks FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY stream_index)) SELECT doc_id, stream_index, breaks, CAST(sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY stream_index) AS BIGINT) AS paragraph FROM b",
    "win_18_ends": f"WITH {_ENDS} SELECT doc_id, seq, start_page, end_page FROM e",
    "win_19_bounds": f"WITH {_MARKS} SELECT doc_id, coalesce(min(start_page) FILTER (title LIKE 'Chapter%') - 1, -1) AS front_end, coalesce(min(start_page) FILTER (title = 'Index'), -1) AS back_start FROM m GROUP BY 1",
    "win_20_levels": f"WITH {_FRAG} SELECT doc_id, stream_index, CAST(least(dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC), 6) AS INTEGER) AS level FROM f",
    "win_23_runs": "WITH r AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations), n AS (SELECT *, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM r) SELECT conv_id, run, role, count(*) AS n, min(turn) AS first, sha256(string_agg(text, ' ' ORDER BY turn)) AS digest FROM n GROUP BY 1, 2, 3",
    "win_24_global": f"WITH {_FRAG} SELECT doc_id, stream_index, page * {PAGE_H} + top AS global_top FROM f",
    "win_25_duplicates": f"""WITH {_FRAG} SELECT doc_id, page, min(stream_index) AS stream_index FROM f GROUP BY doc_id, page, "left", text""",
    "win_26_hashes": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS kept_name FROM documents",
    "win_27_ids": "WITH n AS (SELECT c_custkey, concat(c_mktsegment, '-section') AS b, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer), s AS (SELECT *, CASE WHEN n = 1 THEN '' ELSE concat('_', n) END AS x FROM n) SELECT c_custkey, concat(left(b, 24 - length(x)), x) AS unique_id FROM s",
    "win_31_header_row": f"WITH {_CELLS}, r AS (SELECT table_id, row, count(*) FILTER (trim(text) <> '') AS f, count(*) AS n FROM cells GROUP BY 1, 2) SELECT table_id, coalesce(min(row) FILTER (row < 5 AND f >= 0.7 * n AND f >= 2), 0) AS header_row FROM r GROUP BY 1",
    "win_32_page_numbers": f"WITH {_FRAG}, t AS (SELECT *, CAST(n_chars % 500 AS VARCHAR) AS t FROM f WHERE n_chars % 2 = 0) SELECT f.doc_id, f.page, coalesce((SELECT t.t FROM t WHERE t.doc_id = f.doc_id AND t.page = f.page AND top + height >= 70 ORDER BY top + height DESC, t.t DESC LIMIT 1), (SELECT t.t FROM t WHERE t.doc_id = f.doc_id AND t.page = f.page AND top <= 30 ORDER BY top, t.t LIMIT 1), '') AS page_number FROM (SELECT DISTINCT doc_id, page FROM f) f",
    "tree_01_parents": f"WITH {_MARKS} SELECT doc_id, seq, (SELECT max(p.seq) FROM m p WHERE p.doc_id = m.doc_id AND p.seq < m.seq AND p.level < m.level) AS parent_seq FROM m",
    "tree_02_flat": f"WITH {_MARKS} SELECT doc_id, seq, concat(repeat('  ', level - 1), title) AS line FROM m",
    "ext_01_metrics": f"WITH {_FRAG} SELECT doc_id, page, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, bool_or(top / {PAGE_H} < 0.08 OR top + height > 0.92 * {PAGE_H}) AS has_header_footer FROM f GROUP BY 1, 2",
    "ext_02_drawings": "SELECT l_orderkey, count(*) FILTER (l_partkey % 3 > 0 OR l_suppkey % 2 = 0 OR l_quantity > 4) AS n FROM lineitem GROUP BY 1",
    "ext_08_expand": f"WITH {_AB} SELECT a.page, a.box, min(least(a.x0, b.x0)) AS x0, min(least(a.y0, b.y0)) AS y0, max(greatest(a.x1, b.x1)) AS x1, max(greatest(a.y1, b.y1)) AS y1 FROM a JOIN b ON a.page = b.page AND sqrt(power(greatest(a.x0 - (b.x0 + b.x1) / 2.0, 0, (b.x0 + b.x1) / 2.0 - a.x1), 2) + power(greatest(a.y0 - (b.y0 + b.y1) / 2.0, 0, (b.y0 + b.y1) / 2.0 - a.y1), 2)) <= 50 GROUP BY 1, 2",
    "ext_10_links": f"WITH {_AB} SELECT a.page, a.box, count(*) AS links FROM a JOIN b ON a.page = b.page AND {_HIT} GROUP BY 1, 2",
    "ext_18_titles": f"WITH {_FRAG} SELECT doc_id, font_size AS size, sha256(text) AS digest FROM f WHERE page < 2 AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC, stream_index) = 1",
    "ext_28_rows": f"WITH {_AB} SELECT DISTINCT a.page, a.box FROM a JOIN b ON a.page = b.page AND (a.x0 + a.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN b.y0 AND b.y1",
    "graph_01_components": f"""WITH RECURSIVE {BOXES_SQL}, e AS (SELECT a.page, a.box AS u, b.box AS v FROM boxes a JOIN boxes b ON a.page = b.page AND a.box <> b.box AND ((least(a.y1, b.y1) > greatest(a.y0, b.y0) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 20) OR (least(a.x1, b.x1) > greatest(a.x0, b.x0) AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 20))),
      r AS (SELECT page, box, box AS seen FROM boxes UNION SELECT r.page, r.box, e.v FROM r JOIN e ON e.page = r.page AND e.u = r.seen) SELECT page, box, min(seen) AS component FROM r GROUP BY 1, 2""",
}
