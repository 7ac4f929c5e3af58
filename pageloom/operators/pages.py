"""Page kinds, drawings, media order, scripts, lines, outlines and the compositions of smaller operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import strings as S
from . import detection as D
from . import joins as J
from . import kernels as K
from . import tracking as T
from . import windows as N


def is_form(small: Column, curves: Column, lines: Column, density: Column, chars: Column) -> Column:
    """Pages of little text with many small boxes, or a diagram, border, grid or dense drawing around some."""
    rules = (small >= 10) | ((curves >= 20) & (small >= 5)) | ((lines >= 50) & (small >= 5)) | ((density >= 0.3) & ((curves >= 10) | (small >= 8)))
    return (chars < 500) & rules


def is_cover(page: Column, pages: Column) -> Column:
    """Every first and last page qualifies, whatever is on it."""
    return (page == 1) | (page == pages)


def cover_reason(page: Column, pages: Column, chars: Column, image_share: Column) -> Column:
    side = F.when(page == 1, "Front cover").when(page == pages, "Back cover")
    why = F.array_compact(F.array(F.when(chars < 200, F.lit("minimal text")), F.when(image_share > 0.5, F.lit("high image coverage")), F.when(image_share > 0.6, F.lit("large cover image"))))
    plain = F.when(page == 1, F.lit("first page")).otherwise(F.lit("last page"))
    return F.when(side.isNotNull(), F.concat(side, F.lit(": "), F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise(plain)))


def has_shapes(curves: Column, lines: Column, quads: Column, rects: Column) -> Column:
    return (curves >= 1) | ((lines >= 3) & (rects <= 2)) | (quads >= 2)


def is_table_drawing(curves: Column, rows: Column, columns: Column) -> Column:
    """Grid-like drawings: three curves veto; three by three line groups, or many by two."""
    return (curves < 3) & (((rows >= 3) & (columns >= 3)) | ((rows >= 5) & (columns >= 2)) | ((rows >= 2) & (columns >= 5)))


def extraction_route(page: Column, pages: Column, form: Column, rtl: Column, rasters: Column, tables: Column, vectors: Column) -> Column:
    """What the extractor does with a page: the first rule that applies."""
    return F.when(is_cover(page, pages), "cover").when(form | rtl, "full_page").when(rasters > 0, "raster").when(tables > 0, "table").when(vectors > 0, "vector").otherwise("text")


def element_pages(nodes: DataFrame, key: str) -> DataFrame:
    """Page of each element: its own page attribute, else a page id, else that of the nearest ancestor with one."""
    own = F.coalesce(F.col("attrs")["page"].try_cast("int"), F.regexp_extract(F.coalesce(F.col("attrs")["id"], F.lit("")), "^page_([0-9]+)", 1).try_cast("int"))
    marked = nodes.select(key, "node_id", "parent_id", "tag", own.alias("own"))

    def kernel(p: pd.DataFrame) -> list:
        pages: dict[int, int | None] = {}
        for node, parent, page in zip(p.node_id, p.parent_id, p.own, strict=True):
            pages[node] = int(page) if pd.notna(page) else pages.get(parent) if pd.notna(parent) else None
        return [pages[n] for n in p.node_id]

    return K.per_group(marked, [key], ["node_id"], "page", "int", kernel)


def media_order(media: DataFrame) -> DataFrame:
    """Reading place of each medium: half a place behind its caption, else its own height on the page."""
    return media.withColumn("reading_order", F.coalesce(F.col("caption_order") + 0.5, F.col("y").cast("double")))


def script_type(top: Column, height: Column, parent_top: Column, parent_baseline: Column) -> Column:
    """``superscript``, ``subscript`` or null by the offset of the tops, else by the baseline."""
    diff = top - parent_top
    above = ((diff >= -3) & (diff < 3)) | ((diff < 3) & (top + height <= parent_baseline + 2))
    below = ((diff >= 3) & (diff <= 10)) | ((diff >= 3) & (top >= parent_baseline - 2))
    return F.when(above, "superscript").when(below, "subscript")


def mark_scripts(frags: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Fragments that are scripts of a neighbour, with their kind and the neighbour's merged text."""
    parents = J.script_parents(frags, keys, page)
    other = frags.select(F.col(page).alias("__p"), F.col("stream_index").alias("parent"), F.col("top").alias("__t"), F.col("baseline").alias("__b"), F.col("text").alias("__x"))
    joined = frags.join(parents, keys).join(other, (F.col(page) == F.col("__p")) & (parents["parent"] == other["parent"])).drop(other["parent"])
    kind = script_type(F.col("top"), F.col("height"), F.col("__t"), F.col("__b"))
    mark = F.when(kind == "superscript", "^").otherwise("_")
    return joined.withColumn("script", kind).filter("script IS NOT NULL").select(*keys, "parent", "script", F.concat("__x", mark, F.trim("text")).alias("merged_text"))


def line_cluster_tables(rules: DataFrame, page: str = "page", tolerance: float = 5.0) -> DataFrame:
    """Regions where clusters of horizontal rules and of vertical rules meet: over 50 wide and 30 high."""
    h = N.islands(rules.filter("kind = 'h'").withColumn("n", F.monotonically_increasing_id()), [page], F.col("start"), "n", tolerance).groupBy(page, "island").agg(F.min("start").alias("x0"), F.max("end").alias("x1"), F.count(F.lit(1)).alias("nh"))
    v = N.islands(rules.filter("kind = 'v'").withColumn("n", F.monotonically_increasing_id()), [page], F.col("start"), "n", tolerance).groupBy(page, F.col("island").alias("vi")).agg(F.min("start").alias("y0"), F.max("end").alias("y1"), F.count(F.lit(1)).alias("nv"))
    both = h.filter("nh >= 2").groupBy(page).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).join(v.filter("nv >= 2").groupBy(page).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")), page)
    return both.filter("x1 - x0 > 50 AND y1 - y0 > 30")


def trimmed_tables(tables: DataFrame, captions: DataFrame, page: str = "page") -> DataFrame:
    """Tables cut back at captions that reach into their top or bottom 30 %, five points off, captions in turn."""
    held = captions.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("box", *G.SIDES))).alias("__c"))
    joined = tables.join(held, page, "left")
    start = F.struct(F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"))

    def step(r: Column, c: Column) -> Column:
        hit = (c["x0"] < F.col("x1")) & (F.col("x0") < c["x1"]) & (c["y0"] < r["y1"]) & (r["y0"] < c["y1"])
        tall = r["y1"] - r["y0"]
        top, bottom = c["y0"] < r["y0"] + 0.3 * tall, c["y1"] > r["y1"] - 0.3 * tall
        cut = F.struct(F.greatest(r["y0"], c["y1"] + 5.0).alias("y0"), r["y1"].alias("y1"))
        low = F.struct(r["y0"].alias("y0"), F.least(r["y1"], c["y0"] - 5.0).alias("y1"))
        return F.when(hit & top, cut).when(hit & bottom, low).otherwise(r)

    none = F.array().cast("array<struct<box:bigint,x0:bigint,y0:bigint,x1:bigint,y1:bigint>>")
    done = F.aggregate(F.coalesce("__c", none), start, step)
    return joined.withColumn("__r", done).select(*(c for c in tables.columns if c not in ("y0", "y1")), F.col("__r.y0").alias("y0"), F.col("__r.y1").alias("y1"))


def panel_groups(components: DataFrame, page: str = "page") -> DataFrame:
    """Bounding rectangle of each group of panels with two members at least."""
    return components.groupBy(page, "component").agg(*(getattr(F, f)(c).alias(c) for f, c in (("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1"))), F.count(F.lit(1)).alias("panels")).filter("panels >= 2")


def built_lines(frags: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """Lines of fragments whose tops lie within the tolerance of the line's first; blank lines and those without a size are dropped."""
    grouped = K.per_group(frags, keys, ["top", "left", "stream_index"], "line", "bigint", lambda p: K.anchored_groups(list(p.top), tolerance))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("left", "stream_index", "text"))), lambda x: F.trim(x["text"]))
    made = grouped.groupBy(*keys, "line").agg(S.collapse_space(F.array_join(parts, " ")).alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("height").alias("height"), F.max("font_size").alias("font_size"))
    return made.filter("text <> '' AND font_size IS NOT NULL")


def with_bookmark_chapters(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Blocks with the heuristic chapters replaced by the outline's; for books that have an outline."""
    outlined = marks.select("doc_id").distinct()
    kept = blocks.join(outlined.withColumn("__o", F.lit(True)), "doc_id", "left").filter("__o IS NULL OR label <> 'chapter'").drop("__o")
    return kept.unionByName(marks.filter("level = 1").select("doc_id", F.col("start_page").alias("page"), F.lit(-1).cast("bigint").alias("top"), F.lit("chapter").alias("label"), F.col("title").alias("text")))


def flow_index(*attributes: Column) -> Column:
    """The first attribute that is a number, else -1."""
    return F.coalesce(*(a.try_cast("double") for a in attributes), F.lit(-1.0))


def preprocess(frags: DataFrame, doc: str) -> DataFrame:
    """Global coordinates, duplicates out, repeated headers marked: three operators in a chain."""
    unique = N.drop_duplicates(frags, [doc, "page", "top", "left", "width", "height", "text"], "stream_index")
    placed = N.global_tops(unique, doc, "page", "page_height")
    repeated = D.repeated_at_position(unique, doc).withColumn("repeated", F.lit(True))
    return placed.join(repeated, [doc, "text"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def analyse_pages(pages: DataFrame) -> DataFrame:
    """Complexity, route and report of each document's pages in one chain."""
    return pages.transform(T.page_complexity).transform(T.complexity_report)


def linked_text(texts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Texts whose figure references with a known label have become links."""
    found = J.mentions(texts, labels, dedupe=True).filter("resource IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("mention", "resource"))).alias("__m"))
    link = lambda m: F.concat(F.lit('<link linkend="'), m["resource"], F.lit('">'), m["mention"], F.lit("</link>"))
    new = F.aggregate("__m", F.col("text"), lambda t, m: F.replace(t, m["mention"], link(m)))
    return texts.join(found, key, "left").withColumn("text", F.coalesce(new, F.col("text"))).drop("__m")


def registered_media(used: DataFrame, resources: DataFrame) -> DataFrame:
    """Each resource with where it is used and its final name by first use."""
    uses = used.groupBy("resource").agg(F.array_sort(F.collect_set("chapter")).alias("referenced_in"), F.min("chapter").alias("first_chapter"))
    return resources.join(uses, "resource", "left").withColumn("referenced_in", F.coalesce("referenced_in", F.array().cast("array<bigint>")))


def image_captions(nodes: DataFrame, key: str) -> DataFrame:
    """Caption of each figure: its caption element, else its title, the first that is not blank; and the first file."""
    kids = nodes.select(F.col(key), F.col("parent_id").alias("fig"), F.col("tag").alias("t"), F.col("text").alias("x"), F.col("node_id").alias("n"))
    figures = nodes.filter("tag = 'figure'").select(key, F.col("node_id").alias("fig"), "path")
    own = figures.join(kids, [key, "fig"], "left").groupBy(key, "fig", "path").agg(
        *(F.min(F.when((F.col("t") == tag) & (F.col("x") != ""), F.struct("n", "x"))).alias(tag) for tag in ("caption", "title"))
    )
    return own.select(key, "path", F.coalesce("caption.x", "title.x").alias("caption"))


def page_results(pages: DataFrame) -> DataFrame:
    """Plain conversion of pages: a page without content is a failed row with its error, never an exception."""
    ok = F.coalesce(F.trim("content") != "", F.lit(False))
    return pages.withColumns({"success": ok, "pipeline": F.lit("plain"), "error": F.when(~ok, "no content"), "confidence": table_confidence(F.col("content"))})


def table_confidence(text: Column, default: float = 0.9) -> Column:
    """Confidence noted in a comment, else the default."""
    return F.coalesce(F.regexp_extract(text, r"<!--\s*confidence:\s*([0-9.]+)\s*-->", 1).try_cast("double"), F.lit(default))


def format_runs(frags: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Neighbouring fragments of one format joined, with inline marks for bold ones."""
    made = N.runs(frags, keys, order, ["bold", "font_size"])
    marked = F.when(F.col("bold"), F.concat(F.lit("**"), F.trim("text"), F.lit("**"))).otherwise(F.col("text"))
    return made.withColumn("text", S.size_heading(marked, F.col("font_size")))
