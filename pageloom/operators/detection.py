"""Detection by filters and grouped statistics: noise, repeated text, fonts, tables of rules, page kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import strings as S

# Words that make a text a heading of content and not a running header.
CONTENT_WORDS = ("chapter", "section", "unit", "lesson", "appendix", "part")
REFERENCE_WORDS = ("contents", "index", "glossary", "references", "appendix")
STRONG_WORDS = ("contents", "glossary", "appendix")


def normal_text(text: Column) -> Column:
    return F.lower(S.collapse_space(text))


def is_noise(text: Column, top: Column, height: Column, page_height: Column, repeated: Column) -> Column:
    """Fragments off the page, of production marks, under 6 high, or repeated or mere page numbers in the header and footer zones."""
    t = normal_text(text)
    zone = (top / page_height < 0.12) | (top / page_height > 0.85)
    marks = t.rlike(r"\.indd\b") | t.rlike(r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b") | t.rlike(r"\b[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)\b") | t.rlike(r"^(?:[a-z0-9_\-]+\s+vi|vii|iv)$")
    number = F.trim(t).rlike(r"^(?:[0-9]{1,4}|[ivxlcdm]+)$")
    return (top > page_height * 1.05) | (top < -20) | marks | (F.floor(height) < 6) | ((page_height > 0) & zone & (repeated | number))


def is_spine(text: Column, left: Column, width: Column, height: Column, page_width: Column, rotation: Column) -> Column:
    t = F.trim(text)
    return (t != "") & (F.length(t) <= 3) & (left > page_width * 0.8) & (F.abs(rotation).isin(90, 270) | (height > width * 2))


def is_script(text: Column, width: Column, height: Column) -> Column:
    """Small enough for a super- or subscript, and letters or digits once ^ and _ are gone."""
    t = F.trim(text)
    return (width < 15) & (height < 14) & F.length(t).between(1, 3) & F.regexp_replace(t, "[\\^_]", "").rlike(r"^[\p{L}\p{N}]+$") & ~t.isin("°", "™", "®", "©", "•", "·", "◦", "▪", "½", "¼", "¾", "⅓")


def is_significant_image(width: Column, height: Column, page_area: Column) -> Column:
    return ((width >= 50) & (height >= 50)) | (width * height >= 0.01 * page_area)


def image_kind(in_figure: Column, width: Column, height: Column, sibling_chars: Column) -> Column:
    """Full pages and lone images with little text beside them are decorative, images in figures content."""
    tall = (width > 500) & (height > 700) & (height / width > 1.1) & (height / width < 1.5)
    return F.when(in_figure, "content").when(tall | (sibling_chars < 100), "decorative").otherwise("content")


def is_footer_line(df: DataFrame, doc: str, order: str) -> DataFrame:
    """Flag of headers and footers by an ordered rule list; the first copyright line on the first five pages stays."""
    t, low = F.trim("text"), F.lower(F.trim("text"))
    copyright = low.startswith("copyright") | t.contains("©") | low.contains("(c)")
    first = df.filter(copyright & (F.col("page_num") <= 5)).groupBy(doc, "text").agg(F.min(order).alias("__first"))
    joined = df.join(first, [doc, "text"], "left")
    zone = lambda a, b: (F.col("top") < F.col("page_height") * a) | (F.col("top") > F.col("page_height") * b)
    production = low.rlike(r"[0-9]{3,}-[0-9]{3,}.*\.(?:indd|qxd)|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}|^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}-[0-9]{2}-[0-9]{4}$")
    goes_on = low.rlike(r"\(continued\)|continued on|continued from|\(cont\.?\)")
    margin = (F.length(t) <= 25) & zone(0.10, 0.88) & ((F.col("left") < 0.15 * F.col("page_width")) | (F.col("left") > 0.80 * F.col("page_width"))) & (F.col("font_size") < 16)
    number = (t.rlike("^[0-9]{1,4}$") | (S.is_roman(t) & (F.length(t) <= 5))) & zone(0.08, 0.90)
    low_number = t.rlike("^[0-9]{1,4}$") & (F.col("top") > F.col("page_height") * 0.85)
    publisher = low.rlike(r"isbn[-:\s]*[0-9]|published by|all rights reserved|printed in") & (F.col("top") > F.col("page_height") * 0.80)
    page = low.rlike(r"^page\s+[0-9]+(?:\s+of\s+[0-9]+)?$")
    flag = F.when(t == "", True).when(copyright, ~F.coalesce(F.col(order) == F.col("__first"), F.lit(False))).otherwise(number | production | goes_on | page | margin | low_number | publisher)
    return joined.withColumn("is_footer", flag).drop("__first")


def repeated_headers(df: DataFrame, doc: str, pages: DataFrame) -> DataFrame:
    """Texts that recur in the header or footer zone at one place of a document's pages.

    ``pages`` has the number of pages of each document; three recurrences or a
    tenth of the pages are needed, a hundredth (ten at least) from 500 pages on.
    """
    t = normal_text(F.col("text"))
    y, x = F.bround(F.col("top") / F.col("page_height"), 2), F.bround(F.col("left") / F.col("page_width"), 2)
    held = df.withColumns({"__t": t, "__y": y, "__x": x}).filter(F.length("__t").between(5, 100) & ~F.col("__t").rlike(r"^(?:figure|table|fig\.?)\s+[0-9]+") & ((F.col("__y") < 0.12) | (F.col("__y") > 0.88)))
    counted = held.groupBy(doc, F.bround("__y", 1).alias("y"), F.bround("__x", 1).alias("x"), F.col("__t").alias("norm_text")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n_pages")
    need = F.when(n >= 500, F.greatest(F.lit(10), F.floor(n / 100))).otherwise(F.greatest(F.lit(3), F.floor(n / 10)))
    return counted.join(pages, doc).filter(F.col("n") >= need).select(doc, "norm_text", "n").groupBy(doc, "norm_text").agg(F.max("n").alias("n"))


def sequential(texts: Column) -> Column:
    """Whether distinct texts are page numbers or one running header with page numbers; short content headings are not."""
    low = F.transform(texts, F.lower)
    heading = F.exists(low, lambda t: t.rlike("^(?:" + "|".join(CONTENT_WORDS) + ")") & (F.length(t) < 30))
    numbers = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(F.regexp_extract_all(t, F.lit("[0-9]{1,9}"), F.lit(0)), lambda n: n.cast("bigint")))))
    close = (F.size(numbers) >= 2) & (F.array_max(numbers) - F.array_min(numbers) <= 3 * F.size(numbers))
    roman = F.forall(texts, lambda t: t.rlike("(?i)^[ivxlcdm]+$"))
    page = F.forall(texts, lambda t: t.rlike(r"(?i)^(?:page\s+)?[0-9]+$"))
    return (F.size(texts) >= 2) & ~heading & (close | roman | page)


def repeated_at_position(df: DataFrame, doc: str) -> DataFrame:
    """Texts that recur at one place: one text three times in a zone, or a sequence twice."""
    y, x = F.bround(F.col("top") / F.col("page_height"), 2), F.bround(F.col("left") / F.col("page_width"), 2)
    placed = df.withColumns({"__t": F.trim("text"), "__y": y, "__x": x}).filter(F.length("__t") >= 2)
    # texts of one place are counted first, so only distinct ones are gathered, and only of places that may qualify
    zone = ((F.col("__y") < 0.12) | (F.col("__y") > 0.88)).cast("int")
    each = placed.groupBy(doc, "__y", "__x", "__t").agg(F.count(F.lit(1)).alias("n"), F.sum(zone).alias("z"))
    place = each.groupBy(doc, "__y", "__x").agg(F.collect_set("__t").alias("texts"), F.sum("n").alias("n"), F.sum("z").alias("z")).filter("n >= 3 AND z >= 2")
    only = F.get("texts", F.lit(0))
    single = (F.size("texts") == 1) & (F.col("z") >= 3) & (F.length(only) <= 100) & ~F.lower(only).startswith("copyright") & ~only.contains("©")
    return place.filter(single | sequential(F.col("texts"))).select(doc, F.explode("texts").alias("text")).distinct()


def font_statistics(df: DataFrame, doc: str, order: str) -> DataFrame:
    """Each size's use in a document and its role by the ratio to the body size, which is the most used (the first on a tie)."""
    held = df.filter((F.col("font_size") >= 4) & (F.trim("text") != ""))
    sample = F.when(F.length(F.trim("text")) > 5, F.struct(F.col(order).alias("o"), F.left(F.trim("text"), F.lit(50)).alias("t")))
    sizes = held.groupBy(doc, "font_size").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"), F.min(order).alias("__first"), F.min(sample).alias("__s"))
    body = sizes.groupBy(doc).agg(F.max_by("font_size", F.struct("n", -F.col("__first"))).alias("body_size"))
    return sizes.join(body, doc).withColumn("role", font_role_by_ratio(F.col("font_size") / F.col("body_size"))).select(doc, "font_size", "n", "pages", F.col("__s.t").alias("sample"), "body_size", "role")


def font_role_by_ratio(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "title").when(ratio >= 1.3, "chapter").when(ratio >= 1.15, "section").when(ratio >= 1.05, "subsection").otherwise("body")


def role_tiers(stats: DataFrame, doc: str, most_roles: int = 6) -> DataFrame:
    """Roles of sizes by tiers over the body size b: the largest a title, then a pool of chapters, sections and subsections."""
    b, s = F.col("body_size"), F.col("font_size")
    heading = s >= F.greatest(b + 1, 1.2 * b)
    place = F.row_number().over(W.Window.partitionBy(doc).orderBy(s.desc()))
    ranked = stats.withColumn("__p", place)
    role = (
        F.when(s == b, "body").when(heading & (F.col("__p") == 1), "title").when(heading & (F.col("__p") <= 1 + max(most_roles, 6)) & (F.col("n") >= 2), "chapter")
        .when(s >= F.greatest(b + 0.5, 1.1 * b), "section").when(s >= F.greatest(b, 1.05 * b), "subsection").otherwise("body")
    )
    return ranked.withColumn("tier", role).drop("__p")


def body_size(df: DataFrame, doc: str) -> DataFrame:
    """Median size of long lines, else of all, else 12."""
    return df.groupBy(doc).agg(F.coalesce(F.median(F.when(F.length("text") >= 30, F.col("font_size"))), F.median("font_size"), F.lit(12.0)).alias("body_size"))


def column_bounds(df: DataFrame, doc: str, column: str, page_width: float) -> DataFrame:
    """Exact medians of the left and right ends of each column; column 0 is the page."""
    right = F.col("left") + F.col("width")
    made = df.groupBy(doc, column).agg(F.median("left").alias("l"), F.median(right).alias("r"))
    full = F.col(column) == 0
    left, end = F.when(full, F.lit(0.0)).otherwise(F.col("l")), F.when(full, F.lit(page_width)).otherwise(F.col("r"))
    return made.select(doc, column, left.alias("left_start"), end.alias("right_end"), F.least(0.1 * (end - left), F.lit(20.0)).alias("tolerance"))


def reference_pages(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Pages of contents, index, glossary or references by keywords of the first ten lines and the share of lines that end in a number."""
    ranked = df.withColumn("__n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order)))
    t = F.trim("text")
    long = F.length(t) >= 3
    first = F.lower(F.trim("text"))
    has = lambda words: F.max(F.coalesce((F.col("__n") <= 10) & first.rlike("|".join(words)), F.lit(False)))
    lines, numbered = F.count_if(long), F.count_if(long & t.rlike(r"[\s.,]+[0-9]{1,4}\s*$"))
    made = ranked.groupBy(*keys).agg(has(REFERENCE_WORDS).alias("k"), has(STRONG_WORDS).alias("s"), lines.alias("lines"), numbered.alias("numbered"))
    ratio = F.when(F.col("lines") >= 3, F.col("numbered") / F.col("lines")).otherwise(0.0)
    return made.select(*keys, ((F.col("k") & (ratio > 0.1)) | (ratio > 0.5) | F.col("s")).alias("is_reference"))


def right_to_left(text: Column) -> Column:
    """At least 50 characters, 15 % of those that are no space in Hebrew, Arabic or Syriac script."""
    letters = F.length(F.regexp_replace(text, r"\s+", ""))
    own = F.regexp_count(text, F.lit(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"))
    return F.coalesce((letters >= 50) & (own >= 0.15 * letters), F.lit(False))


def real_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables that pass the rules: accuracy, size, area, fill, no list, no prose, no figure captions.

    ``tables``: table_id, accuracy, x0, y0, x1, y1; ``cells``: table_id, row, col, text.
    """
    t = F.trim("text")
    listed = t.rlike(r"(?i)^(?:[•●○■□▪▫·–—-]|\(?[0-9]{1,3}[.)]|[ivxlcdm]+[.)])(?:\s|$)")
    made = cells.groupBy("table_id").agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count_if(t != "").alias("filled"), F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("col") == 0) & listed).alias("listed"), F.count_if(F.col("col") == 0).alias("firsts"), F.count_if(F.length(t) > 100).alias("long"),
        F.count_if(S.is_figure_caption(t)).alias("captions"),
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ok = (
        (F.col("accuracy") >= 60) & (F.col("rows") >= 2) & (F.col("cols") >= 2) & (area >= 5000) & (F.col("filled") >= 0.1 * F.col("n")) & (F.col("listed") <= 0.7 * F.col("firsts"))
        & (F.col("long") <= 0.5 * F.col("n")) & (F.col("captions") == 0)
    )
    return tables.join(made, "table_id", "left").withColumn("is_table", F.coalesce(ok, F.lit(False))).select(*tables.columns, "is_table")


def header_row(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The first of a table's first five rows that is filled to 70 %, with short cells and enough of them; else row 0."""
    t = F.trim("text")
    rows = cells.groupBy(*keys, "row").agg(F.count_if(t != "").alias("filled"), F.count(F.lit(1)).alias("n"), F.max(F.length(t)).alias("longest"))
    good = (F.col("row") < 5) & (F.col("filled") >= 0.7 * F.col("n")) & (F.col("longest") < 80) & (F.col("filled") >= F.greatest(F.lit(2.0), 0.5 * F.col("n")))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(good, F.col("row"))), F.lit(0)).alias("header_row"))


def ruled_tables(lines: DataFrame, page: str = "page", tolerance: float = 5.0, ratio: float = 0.7, least_crossings: int = 12) -> DataFrame:
    """Grids of rules on a page: enough long horizontal and vertical lines that cross often enough; their bounding box.

    ``lines``: page, kind (h or v), start, end, pos.
    """
    h = lines.filter("kind = 'h'").select(page, F.col("start").alias("a"), F.col("end").alias("b"), F.col("pos").alias("y"))
    v = lines.filter("kind = 'v'").select(F.col(page).alias("__p"), F.col("start").alias("c"), F.col("end").alias("d"), F.col("pos").alias("x"))
    box = h.groupBy(page).agg(F.min("a").alias("x0"), F.max("b").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("nh"))
    span = h.join(box, page).groupBy(page).agg(F.count_if(F.col("b") - F.col("a") >= 0.6 * (F.col("x1") - F.col("x0"))).alias("sh"))
    tall = v.join(box.select(F.col(page).alias("__p"), "y0", "y1"), "__p").groupBy("__p").agg(F.count_if(F.col("d") - F.col("c") >= 0.5 * (F.col("y1") - F.col("y0"))).alias("sv"), F.count(F.lit(1)).alias("nv"))
    met = (F.col("x") >= F.col("a") - tolerance) & (F.col("x") <= F.col("b") + tolerance) & (F.col("y") >= F.col("c") - tolerance) & (F.col("y") <= F.col("d") + tolerance)
    crossings = h.join(v, (h[page] == v["__p"]) & met).groupBy(page).agg(F.count(F.lit(1)).alias("crossings"))
    all_of = box.join(span, page).join(tall, box[page] == tall["__p"]).join(crossings, page)
    size = (F.col("x1") - F.col("x0") >= 100) & (F.col("y1") - F.col("y0") >= 50)
    enough = (F.col("nh") >= 5) & (F.col("nv") >= 4) & (F.col("sh") >= 4) & (F.col("sv") >= 3)
    often = (F.col("crossings") >= least_crossings) & (F.col("crossings") >= ratio * F.col("nh") * F.col("nv"))
    return all_of.filter(size & enough & often).select(page, "x0", "y0", "x1", "y1", "crossings")


def structure_box(lines: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Bounding box of the near-axis lines of each table, where there are ``least`` at least."""
    return lines.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def column_overlap(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Consecutive columns whose vertical extents share over half of their mean height."""
    held = df.groupBy(*keys, column).agg(F.min("top").alias("a"), F.max(F.col("top") + F.col("height")).alias("b"))
    w = W.Window.partitionBy(*keys).orderBy(column)
    c, d = F.lead("a").over(w), F.lead("b").over(w)
    shared = F.least("b", "d") - F.greatest("a", "c")
    return held.withColumns({"c": c, "d": d}).filter("c IS NOT NULL").select(*keys, column, (shared > 0.25 * ((F.col("b") - F.col("a")) + (F.col("d") - F.col("c")))).alias("overlap"))


def line_pivot(df: DataFrame, keys: list[str], order: str, most: int = 4) -> DataFrame:
    """Text of each line by column bucket: columns beyond ``most`` and negative ones count as ``most``, several joined by a bar."""
    bucket = F.when((F.col("col_id") > most) | (F.col("col_id") < 0), most).otherwise(F.col("col_id"))
    within = df.groupBy(*keys, bucket.alias("bucket"), "col_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda x: x["text"]), " ").alias("t"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "t"))), lambda x: x["t"]), " | ")
    wide = within.groupBy(*keys).pivot("bucket", list(range(most + 1))).agg(texts)
    return wide.select(*keys, *(F.coalesce(F.col(str(i)), F.lit("")).alias(f"col{i}_text") for i in range(most + 1)))


def text_metrics(df: DataFrame, keys: list[str], page_area: float, page_height: float) -> DataFrame:
    """Blocks, their area's share, characters, words, and the footnote and header flags of a page."""
    low, high = F.col("top") / page_height, F.col("top") + F.col("height")
    note = (high > 0.85 * page_height) & ((F.col("font_size") < 9) | F.trim("text").rlike(r"^(?:[0-9]{1,2}|[*†‡])\s"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"), F.bround(F.sum(F.col("width") * F.col("height")) / page_area, 4).alias("area_share"), F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.sum(F.size(F.array_remove(F.split(F.trim("text"), r"\s+"), ""))).cast("bigint").alias("words"), F.max(F.coalesce(note, F.lit(False))).alias("has_footnotes"),
        F.max((low < 0.08) | (high > 0.92 * page_height)).alias("has_header_footer"),
    )


def complex_drawings(curves: Column, filled: Column, segments: Column) -> Column:
    return (curves > 0) | filled | (segments > 4)


def aligned_text_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a page's texts line up as a table: two columns and two rows, to the nearest ten, with two members each."""
    at = lambda c: (F.bround(F.col(c) / 10, 0) * 10)
    x = df.groupBy(*keys, at("left").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(*keys).agg(F.count(F.lit(1)).alias("columns"))
    y = df.groupBy(*keys, at("top").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    both = df.select(*keys).distinct().join(x, keys, "left").join(y, keys, "left")
    return both.select(*keys, ((F.coalesce("columns", F.lit(0)) >= 2) & (F.coalesce("rows", F.lit(0)) >= 2)).alias("is_table"))


def toc_span(df: DataFrame, doc: str, order: str) -> DataFrame:
    """Rows of the table of contents: from its heading to the first large line on a later page, else to the end."""
    heading = F.lower(F.trim("text")).isin("contents", "table of contents")
    start = df.filter(heading).groupBy(doc).agg(F.min_by(F.struct("page", "font_size"), F.col(order)).alias("h"), F.min(order).alias("start"))
    joined = df.join(start, doc)
    stops = (F.col("page") > F.col("h.page")) & (F.col("font_size") >= F.col("h.font_size")) & (F.length(F.trim("text")) > 3) & ~F.trim("text").rlike("^[0-9]+$")
    end = joined.filter(stops & (F.col(order) > F.col("start"))).groupBy(doc).agg(F.min(order).alias("stop"))
    return joined.join(end, doc, "left").filter((F.col(order) >= F.col("start")) & (F.col(order) < F.coalesce("stop", F.lit(2**31)))).select(doc, order, "text")


def chapter_titles(df: DataFrame, doc: str, order: str) -> DataFrame:
    """The largest line of each document's first two pages, the first of equals."""
    return df.filter("page < 2 AND trim(text) <> ''").groupBy(doc).agg(F.max_by("text", F.struct("font_size", -F.col(order))).alias("title"), F.max("font_size").alias("size"))
