"""Sequence operators that need one window pass: tolerances, islands, runs, prefix sums, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import strings as S
from . import kernels as K


def _w(keys: list[str], *order) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def baseline_tolerance(df: DataFrame, keys: list[str], y: str, tie: str) -> DataFrame:
    """Half the median of the positive steps between sorted baselines, 4 at least."""
    step = F.col(y) - F.lag(y).over(_w(keys, y, tie))
    stepped = df.withColumn("__s", step)
    half = F.median(F.when(F.col("__s") > 0, F.col("__s"))) * 0.5
    return stepped.groupBy(*keys).agg(F.greatest(F.lit(4.0), F.coalesce(half, F.lit(4.0))).alias("tolerance"))


def islands(df: DataFrame, keys: list[str], x: Column, tie: str, tolerance, out: str = "island") -> DataFrame:
    """Number, from 1, of the run that a row is in; a run goes on while the step from the previous row is within the tolerance."""
    order = _w(keys, x, F.col(tie))
    gap = x - F.lag(x).over(order)
    begins = F.when(gap.isNull() | (gap > tolerance), 1).otherwise(0)
    return df.withColumn("__b", begins).withColumn(out, F.sum("__b").over(order.rowsBetween(W.Window.unboundedPreceding, 0)).cast("bigint")).drop("__b")


def mean_baseline(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    return df.withColumn("norm_baseline", F.bround(F.avg(y).over(W.Window.partitionBy(*keys)), 1))


def paragraph_breaks(df: DataFrame, keys: list[str], order: list[str], small: float = 3.0) -> DataFrame:
    """Flag and paragraph number: a new one where the column or block changes or the gap below the previous line is over ``small``."""
    w = _w(keys, *order)
    was = lambda c: F.lag(c).over(w)
    gap = F.col("top") - (was("top") + was("height"))
    breaks = was("top").isNull() | (was("col_id") != F.col("col_id")) | (was("block") != F.col("block")) | (gap > small)
    flagged = df.withColumn("breaks", breaks)
    return flagged.withColumn("paragraph", F.sum(F.col("breaks").cast("int")).over(w.rowsBetween(W.Window.unboundedPreceding, 0)).cast("bigint"))


# Words after which a phrase goes on.
CONTINUES = "including and or the for in of to a an as with from by at on into through during such both each all other these those many".split()
CONTINUES_FAR = "including and or the for in of to".split()


def continues_word(df: DataFrame, keys: list[str], order: list[str], tolerance: float = 3.0) -> DataFrame:
    """Flag: the fragment goes on with its predecessor on the same line, column and block."""
    w = _w(keys, *order)
    was = lambda c: F.lag(c).over(w)
    text, before = F.col("text"), was("text")
    gap = F.abs(F.col("left") - (was("left") + was("width")))
    ends = lambda words: F.lower(F.rtrim(before)).rlike("(?:" + "|".join(words) + "),?$")
    near = F.when(text.rlike(r"^[,.;:!?)\]}]") | before.rlike(r"[(\[{]$") | ends(CONTINUES), F.lit(True)).otherwise(text.rlike(r"^\p{Lu}") & (gap <= 2.0))
    same = (F.abs(was("baseline") - F.col("baseline")) <= tolerance) & (was("col_id") == F.col("col_id")) & (was("block") == F.col("block"))
    goes_on = before.endswith(" ") | text.startswith(" ") | before.endswith("-") | F.when(gap <= 5.0, near).when(gap <= 15.0, ends(CONTINUES_FAR)).otherwise(F.lit(False))
    return df.withColumn("continues", F.coalesce(same & goes_on, F.lit(False)))


def page_merges(df: DataFrame, doc: str, page: str, y: str) -> DataFrame:
    """For each page, whether its last fragment goes on with the first of the next page, and their joined text."""
    edges = df.groupBy(doc, page).agg(
        F.max_by(F.struct("text", "col_id"), F.struct(F.col(y), -F.col("stream_index"))).alias("last"), F.min_by(F.struct("text", "col_id"), F.struct(y, "stream_index")).alias("first")
    )
    nxt = F.lead(F.struct(F.col("first"), F.col(page).alias("p"))).over(W.Window.partitionBy(doc).orderBy(page))
    paired = edges.withColumn("n", nxt)
    a, b = F.rtrim(F.col("last.text")), F.ltrim(F.col("n.first.text"))
    ends = a.rlike(r"[.!?:;]$") & ~a.endswith("...")
    heading = (F.length(b) <= 50) & b.rlike(r"^\p{Lu}+$")
    initial = (F.length(b) > 2) & b.rlike(r"^\p{Lu}\s*\.")
    columns = ((F.col("last.col_id") == 0) != (F.col("n.first.col_id") == 0))
    merges = F.coalesce((a != "") & (b != "") & ~ends & ~heading & ~initial & ~F.coalesce(columns, F.lit(False)), F.lit(False))
    joined = F.when(merges, S.join_hyphenated(F.col("last.text"), F.col("n.first.text")))
    return paired.select(doc, page, merges.alias("merges"), joined.alias("joined"))


def bookmark_ends(marks: DataFrame, pages: str = "total_pages") -> DataFrame:
    """Last page of each bookmark: before the next one of its level or above, else the document's last; never before its start."""
    closing = lambda p: [None if j < 0 else int(p.start_page[j]) for j in K.outline_ends(list(p.level))]
    closed = K.per_group(marks, ["doc_id"], ["seq"], "__next", marks.schema["start_page"].dataType.simpleString(), closing)
    end = F.greatest(F.col("start_page"), F.coalesce(F.col("__next") - 1, F.col(pages) - 1))
    return closed.withColumn("end_page", end).drop("__next")


def matter_bounds(marks: DataFrame) -> DataFrame:
    """First page of the body and the last before the back matter, -1 where there is none."""
    t = F.lower("title")
    body = t.rlike(r"^(?:chapter|part)\b|^[0-9]+")
    back = t.rlike(r"^(?:index|glossary|bibliography|references|appendix)\b")
    return marks.groupBy("doc_id").agg(F.coalesce(F.min(F.when(body, F.col("start_page"))) - 1, F.lit(-1)).alias("front_end"), F.coalesce(F.min(F.when(back, F.col("start_page"))), F.lit(-1)).alias("back_start"))


def heading_levels(df: DataFrame, doc: str, size: str, most: int = 6) -> DataFrame:
    """Level by rank of the font size, largest first. Sizes are ranked among the distinct ones, so a long document is no hot window."""
    sizes = df.select(doc, size).distinct()
    ranked = sizes.withColumn("level", F.least(F.row_number().over(_w([doc], F.col(size).desc())), F.lit(most)))
    return df.join(ranked, [doc, size])


def runs(df: DataFrame, keys: list[str], order: str, same: list[str], text: str = "text", separator: str = " ") -> DataFrame:
    """Neighbouring rows with equal ``same`` columns as one row: their texts joined in order."""
    w = _w(keys, order)
    changed = ~F.coalesce(F.lag(F.struct(*same)).over(w) == F.struct(*same), F.lit(False))
    numbered = df.withColumn("__c", changed.cast("int")).withColumn("run", F.sum("__c").over(w.rowsBetween(W.Window.unboundedPreceding, 0)).cast("bigint"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda p: p[text])
    return numbered.groupBy(*keys, "run", *same).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.array_join(parts, separator).alias(text))


def global_tops(df: DataFrame, doc: str, page: str, height: str) -> DataFrame:
    """Offset of each page: the heights of all before it."""
    pages = df.groupBy(doc, page).agg(F.max(height).alias("__h"))
    offsets = pages.withColumn("offset", F.coalesce(F.sum("__h").over(_w([doc], page).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(offsets.drop("__h"), [doc, page])


def drop_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; a grouped minimum, so a hot key is pre-aggregated."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r"))
    return best.select(*(F.col(c) if c in keys else F.col("__r").getField(c).alias(c) for c in df.columns))


def content_names(df: DataFrame, content: Column, name: str, order: str) -> DataFrame:
    """Each file with its content hash and the name of the first file of the same content."""
    hashed = df.withColumn("sha256", F.sha2(content, 256))
    first = hashed.groupBy("sha256").agg(F.min_by(name, F.col(order)).alias("kept_name"))
    return hashed.join(first, "sha256")


def unique_ids(df: DataFrame, keys: list[str], base: str, order: str, longest: int = 24) -> DataFrame:
    """Ids made unique: the first keeps its name, others get ``_2``, ``_3`` ..., cut to ``longest`` characters with the suffix whole."""
    n = F.row_number().over(_w([*keys, base], order))
    suffix = F.when(n == 1, "").otherwise(F.concat(F.lit("_"), n.cast("string")))
    return df.withColumn("__s", suffix).withColumn("unique_id", F.concat(F.left(F.col(base), F.lit(longest) - F.length("__s")), F.col("__s"))).drop("__s")


def confirmed_lists(df: DataFrame, keys: list[str], order: str, kind: str, ahead: int = 9) -> DataFrame:
    """Flag: the list item stands in a run of its kind (one for bullets, two for ordered) within the next ``ahead`` rows, indents within 15, gaps within 2.5 heights."""
    w = _w(keys, order)
    gap = F.col("top") - F.lag("top").over(w)
    cut = F.lag(kind).over(w).isNull() | ~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | (gap > 2.5 * F.col("height")) | (F.abs(F.col("left") - F.lag("left").over(w)) > 15)
    run = df.withColumn("__c", cut.cast("int")).withColumn("__r", F.sum("__c").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(_w([*keys, "__r"], order).rowsBetween(-ahead, ahead))
    need = F.when(F.col(kind) == "itemized", 1).otherwise(2)
    return run.withColumn("confirmed", F.col(kind).isNotNull() & (size >= need)).drop("__c", "__r")


def page_numbers(df: DataFrame, keys: list[str], page_height: float, margin: float = 150.0) -> DataFrame:
    """The page number printed on each page: the lowest near the bottom, else the highest near the top, else empty."""
    number = S.is_page_number(F.col("text"))
    bottom, text = F.col("top") + F.col("height"), F.trim("text")
    low = F.max(F.when(number & (bottom >= page_height - margin), F.struct(bottom.alias("y"), text.alias("t"))))
    high = F.min(F.when(number & (F.col("top") <= margin), F.struct(F.col("top").alias("y"), text.alias("t"))))
    return df.groupBy(*keys).agg(F.coalesce(low["t"], high["t"], F.lit("")).alias("page_number"))


def parents(marks: DataFrame) -> DataFrame:
    """Parent of each preorder row: the last one before it with a smaller level."""
    above = lambda p: [None if j < 0 else int(p.seq[j]) for j in K.outline_parents(list(p.level))]
    return K.per_group(marks, ["doc_id"], ["seq"], "parent_seq", marks.schema["seq"].dataType.simpleString(), above)


def paragraph_boundaries(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Bottoms of lines after which the gap is over 1.5 of the upper-median height."""
    heights = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("height") > 0, F.col("height")))).alias("__h"))
    typical = heights.select(*keys, F.coalesce(F.get("__h", F.floor(F.size("__h") / 2).cast("int")), F.lit(12)).alias("__t"))
    nxt = F.lead("top").over(_w(keys, "top", tie))
    bottom = F.col("top") + F.col("height")
    return df.withColumn("__n", nxt).join(typical, keys).filter(F.col("__n") - bottom > 1.5 * F.col("__t")).select(*keys, bottom.alias("y"))
