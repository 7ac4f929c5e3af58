"""Joins of references, rectangles, captions and pages.

Geometric joins are bounded to a page: the page is the equi-key and the
inequalities are the residual condition, so a join shuffles on the page and
compares within it. Nearest-neighbour joins keep the best row by a grouped
minimum of a struct, which is pre-aggregated, not by ranking whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as G


def renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keep else prefix + c) for c in df.columns))


def probe(left: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows with the looked-up value; of several the last by value, so the result is one row for each left row."""
    one = names.groupBy(key).agg(F.max(value).alias(value))
    return left.join(one, key, "left")


def first_found(left: DataFrame, lookups: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """The value of the first look-up that has the row's key: (table, key, value) in order of preference."""
    made = []
    for i, (names, key, value) in enumerate(lookups):
        one = names.groupBy(F.col(key).alias(f"__k{i}")).agg(F.max(value).alias(f"__v{i}"))
        left = left.join(one, F.col(key) == F.col(f"__k{i}"), "left")
        made.append(F.col(f"__v{i}"))
    return left.withColumn(out, F.coalesce(*made)).drop(*(f"__{x}{i}" for i in range(len(lookups)) for x in "kv"))


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: broken links, unreferenced resources, undeclared entities."""
    return left.join(right.select(*on), on, "left_anti")


def mentions(texts: DataFrame, labels: DataFrame, text: str = "text", dedupe: bool = False) -> DataFrame:
    """Figure references in texts with the resource of that label (``label, resource``), null where there is none."""
    patterns = (r"(?i)(Figure\s+[0-9]+(?:\.[0-9]+)?)", r"(?i)(Fig\.\s+[0-9]+(?:\.[0-9]+)?)", r"(?i)\((Figure\s+[0-9]+(?:\.[0-9]+)?)\)", r"(?i)see\s+(Figure\s+[0-9]+(?:\.[0-9]+)?)")
    all_found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))
    found = F.array_distinct(all_found) if dedupe else all_found
    rows = texts.withColumn("mention", F.explode(found)).withColumn("__l", F.lower(F.regexp_replace("mention", r"(?i)^fig\.", "figure")))
    side = labels.select(F.lower("label").alias("__l"), "resource")
    return rows.join(side, "__l", "left").drop("__l")


def within_page(a: DataFrame, b: DataFrame, page: str, condition, how: str = "inner") -> DataFrame:
    """Pairs of one page for which ``condition(a's sides, b's sides)`` holds; b's columns get the prefix ``b_``."""
    other = renamed(b, "b_", (page,))
    return a.join(other, (a[page] == other[page]) & condition(G.sides(), G.sides("b_")), how).drop(other[page])


def overlapping(a: DataFrame, b: DataFrame, page: str = "page") -> DataFrame:
    return within_page(a, b, page, G.intersects)


def without_overlap(a: DataFrame, b: DataFrame, least_iou: float, least_inside: float, page: str = "page") -> DataFrame:
    """Rectangles of ``a`` that no rectangle of ``b`` covers: neither by intersection over union nor by the share inside."""
    other = renamed(b, "b_", (page,))
    x, y = G.sides(), G.sides("b_")
    return a.join(other, (a[page] == other[page]) & ((G.iou(x, y) > least_iou) | (G.share_inside(x, y) > least_inside)), "left_anti")


def nearest(a: DataFrame, b: DataFrame, keys: list[str], page: str, condition, distance, ties: list[str]) -> DataFrame:
    """Each row of ``a`` with its nearest partner in ``b`` (prefix ``b_``), nulls where none qualifies."""
    other = renamed(b, "b_", (page,))
    x, y = G.sides(), G.sides("b_")
    pairs = a.join(other, (a[page] == other[page]) & condition(x, y)).drop(other[page])
    rank = F.struct(distance(x, y).alias("d"), *(F.col(f"b_{t}").alias(f"t{i}") for i, t in enumerate(ties)))
    value = F.struct(distance(x, y).alias("distance"), *(F.col(c) for c in pairs.columns if c.startswith("b_")))
    best = pairs.groupBy(*keys).agg(F.min_by(value, rank).alias("__best"))
    names = ["distance", *(c for c in pairs.columns if c.startswith("b_"))]
    return a.join(best, keys, "left").select(*a.columns, *(F.col("__best").getField(n).alias(n) for n in names))


def caption_gap(most: float):
    """Condition and distance of captions above or below a region: overlap in x, gap in y at most ``most``."""

    def gap(r, c) -> Column:
        return F.when(c[3] <= r[1], r[1] - c[3]).when(c[1] >= r[3], c[1] - r[3])

    return (lambda r, c: (c[0] < r[2]) & (r[0] < c[2]) & gap(r, c).isNotNull() & (gap(r, c) <= most)), gap


def centre_distance(most: float):
    def distance(r, c) -> Column:
        (ax, ay), (bx, by) = G.centre(r), G.centre(c)
        return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))

    return (lambda r, c: distance(r, c) <= most), distance


def near_keyword(a: DataFrame, words: DataFrame, below: float = 100.0, aside: float = 50.0, page: str = "page") -> DataFrame:
    """Rectangles with a keyword that intersects them or lies near: vertically within ``below``, horizontally within ``aside``."""
    other = renamed(words, "b_", (page,))
    r, c = G.sides(), G.sides("b_")
    near = (c[1] <= r[3] + below) & (c[3] >= r[1] - below) & (c[0] <= r[2] + aside) & (c[2] >= r[0] - aside)
    return a.join(other, (a[page] == other[page]) & near, "left_semi")


def first_cell(points: DataFrame, cells: DataFrame, keys: list[str], order: str, page: str = "page") -> DataFrame:
    """Each rectangle with the first cell that holds its centre."""
    other = renamed(cells, "b_", (page,))
    x, y = G.centre(G.sides())
    pairs = points.join(other, (points[page] == other[page]) & G.holds(G.sides("b_"), x, y)).drop(other[page])
    best = pairs.groupBy(*keys).agg(F.min(f"b_{order}").alias("cell"))
    return points.join(best, keys, "left")


def outside_zones(points: DataFrame, zones: DataFrame, page: str = "page") -> DataFrame:
    """Rectangles whose centre lies in no exclusion zone, borders included."""
    other = renamed(zones, "b_", (page,))
    x, y = G.centre(G.sides())
    return points.join(other, (points[page] == other[page]) & G.holds(G.sides("b_"), x, y), "left_anti")


def caption_of_media(paragraphs: DataFrame, media: DataFrame, after: int = 3, before: int = 2) -> DataFrame:
    """Captions with the nearest media by ordinal in the same block: at most ``after`` places behind it, ``before`` ahead of it."""
    p, m = paragraphs.alias("p"), media.alias("m")
    step = F.col("p.ordinal") - F.col("m.ordinal")
    pairs = p.join(m, (F.col("p.block") == F.col("m.block")) & step.between(-before, after) & (step != 0))
    return pairs.groupBy(F.col("p.block").alias("block"), F.col("p.ordinal").alias("ordinal")).agg(F.min_by("m.ordinal", F.struct(F.abs(step), F.col("m.ordinal"))).alias("media"))


def script_parents(frags: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Script-sized fragments with the larger neighbour they belong to: gap 0 to 5, under 3/4 of its height, tops within 10."""
    small = frags.filter((F.col("width") < 15) & (F.col("height") < 14) & (F.length(F.trim("text")).between(1, 3)))
    other = renamed(frags, "b_", (page,))
    right = F.col("left") - (F.col("b_left") + F.col("b_width"))
    left = F.col("b_left") - (F.col("left") + F.col("width"))
    gap = F.when(right.between(0, 5), right).when(left.between(0, 5), left)
    top = F.abs(F.col("top") - F.col("b_top"))
    pairs = small.join(other, (small[page] == other[page]) & gap.isNotNull() & (F.col("height") < 0.75 * F.col("b_height")) & (top <= 10)).drop(other[page])
    return pairs.groupBy(*keys).agg(F.min_by("b_stream_index", F.struct(gap, top, F.col("b_stream_index"))).alias("parent"))


def panel_edges(panels: DataFrame, gap: float = 20.0, page: str = "page", key: str = "box") -> DataFrame:
    """Neighbouring panels of a page, side by side or one above the other, each pair once."""
    other = renamed(panels, "b_", (page,))
    a, b = G.sides(), G.sides("b_")
    beside = (F.least(a[3], b[3]) > F.greatest(a[1], b[1])) & ((F.greatest(a[0], b[0]) - F.least(a[2], b[2])) <= gap)
    above = (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & ((F.greatest(a[1], b[1]) - F.least(a[3], b[3])) <= gap)
    pairs = panels.join(other, (panels[page] == other[page]) & (F.col(key) < F.col(f"b_{key}")) & (beside | above)).drop(other[page])
    return pairs.select(page, F.col(key).alias("u"), F.col(f"b_{key}").alias("v"), F.when(beside, "horizontal").otherwise("vertical").alias("direction"))


def boundary_above(points: DataFrame, boundaries: DataFrame, page: str = "page") -> DataFrame:
    """As-of join: the largest boundary (``page, y``) strictly above each point's ``y``, its own y where there is none.

    Both sides are laid in one sequence by page and y, and the last boundary is carried on.
    """
    both = points.withColumn("__b", F.lit(None).cast("double")).withColumn("__o", F.lit(0)).unionByName(
        boundaries.select(page, "y").distinct().withColumn("__b", F.col("y").cast("double")).withColumn("__o", F.lit(1)), allowMissingColumns=True
    )
    prior = W.Window.partitionBy(page).orderBy("y", "__o").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    return both.withColumn("boundary", F.last("__b", ignorenulls=True).over(prior)).filter("__o = 0").withColumn("boundary", F.coalesce("boundary", F.col("y").cast("double"))).drop("__b", "__o")


def active_bookmark(pages: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """The deepest bookmark whose pages hold each page (``doc_id, page``), null where there is none."""
    b = bookmarks.select(F.col("doc_id").alias("__d"), "seq", "level", "start_page", "end_page")
    pairs = pages.join(b, (F.col("doc_id") == F.col("__d")) & F.col("page").between(F.col("start_page"), F.col("end_page")))
    best = pairs.groupBy("doc_id", "page").agg(F.max_by("seq", F.struct("level", -F.col("seq"))).alias("bookmark"))
    return pages.join(best, ["doc_id", "page"], "left")


def bookmarks_at(pages: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Pages with the bookmarks that start on them (first page is 1), by level."""
    start = bookmarks.groupBy("doc_id", (F.col("start_page") + 1).alias("page")).agg(F.array_sort(F.collect_list(F.struct("level", "seq"))).alias("marks"))
    return pages.join(start, ["doc_id", "page"], "left")


def nearest_column(left: Column, centres: Column, most: float = 50.0) -> Column:
    """Index of the column centre nearest to ``left``, null if none is near enough."""
    gaps = F.transform(centres, lambda c, i: F.struct(F.abs(c - left).alias("d"), i.alias("i")))
    best = F.array_min(gaps)
    return F.when(best["d"] <= most, best["i"])
