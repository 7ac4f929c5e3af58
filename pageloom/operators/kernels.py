"""Sequential operators: order-dependent state within one page or document.

Each is a plain function over the rows of one group, applied by ``per_group``.
A group is a page (a few thousand rows at most by nature) or one document's
outline, never a key that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..shipping import ship


def _same_as_before(column: pa.ChunkedArray) -> np.ndarray:
    """For every row but the first: whether the key is that of the row before; null equals null."""
    now, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    equal = pc.fill_null(pc.equal(now, before), False)
    return pc.or_(equal, pc.and_(pc.is_null(now, nan_is_null=True), pc.is_null(before, nan_is_null=True))).to_numpy()


class Values(np.ndarray):
    """A column of one group: an array whose elements come out as Python values."""

    def __iter__(self):
        return iter(self.tolist())


class Group:
    """The rows of one group by column name; a view, so that many small groups cost little."""

    __slots__ = ("_columns", "_begin", "_end")

    def __init__(self, columns: dict[str, Values], begin: int, end: int):
        self._columns, self._begin, self._end = columns, begin, end

    def __getattr__(self, name: str) -> Values:
        try:
            return self._columns[name][self._begin : self._end]
        except KeyError:
            raise AttributeError(name) from None

    def __len__(self) -> int:
        return self._end - self._begin

    def records(self) -> list[dict]:
        return [dict(zip(self._columns, row, strict=True)) for row in zip(*(c[self._begin : self._end] for c in self._columns.values()), strict=True)]


def per_group(df: DataFrame, keys: list[str], order: list[str], out: str, kind: str, kernel: Callable[[Group], list]) -> DataFrame:
    """``df`` with a column that ``kernel`` computes from each group's rows in order.

    Groups are small and many, so they pass through Python in batches of sorted
    rows rather than one call each; only the group at a batch's end is held over.
    The rows themselves stay Arrow tables, so no value changes on the way.
    """
    ship(df.sparkSession)
    narrow = df.drop(out)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema]
    out_type = to_arrow_type(DataType.fromDDL(kind))

    def begins(rows: pa.Table) -> np.ndarray:
        """Where groups begin."""
        same = np.ones(len(rows) - 1, bool)
        for k in keys:
            same &= _same_as_before(rows.column(k))
        return np.concatenate([[0], np.nonzero(~same)[0] + 1])

    def solved(rows: pa.Table, starts: np.ndarray):
        frame, values = rows.to_pandas(), []
        columns = {name: frame[name].to_numpy().view(Values) for name in frame.columns}
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            values.extend(kernel(Group(columns, i, j)))
        made = rows.append_column(out, pa.chunked_array([pa.Array.from_pandas(pd.Series(values, dtype=object), type=out_type)]))
        return made.combine_chunks().to_batches()

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            starts = begins(rows)
            if len(starts) > 1:
                yield from solved(rows.slice(0, int(starts[-1])), starts[:-1])
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield from solved(held, np.array([0]))

    dealt = narrow.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join([*fields, f"`{out}` {kind}"]))


def outline_parents(levels: list[int]) -> list[int]:
    """For each row of a preorder outline the last one before it with a smaller level, -1 if there is none."""
    out, open_rows = [], []
    for i, level in enumerate(levels):
        while open_rows and levels[open_rows[-1]] >= level:
            open_rows.pop()
        out.append(open_rows[-1] if open_rows else -1)
        open_rows.append(i)
    return out


def outline_ends(levels: list[int]) -> list[int]:
    """For each row of a preorder outline the next one of its level or above, -1 if there is none."""
    out, open_rows = [-1] * len(levels), []
    for i, level in enumerate(levels):
        while open_rows and levels[open_rows[-1]] >= level:
            out[open_rows.pop()] = i
        open_rows.append(i)
    return out


def running_mean_groups(values: list[float], tolerance: float) -> list[int]:
    """Group numbers: a value joins while it is within the tolerance of the mean of the group so far."""
    out, total, n, group = [], 0.0, 0, 0
    for v in values:
        if n and abs(v - total / n) <= tolerance:
            total, n = total + v, n + 1
        else:
            group, total, n = group + 1, v, 1
        out.append(group)
    return out


def anchored_groups(values: list[float], tolerance: float) -> list[int]:
    """Group numbers: a value joins while it is within the tolerance of the group's first."""
    out, anchor, group = [], None, 0
    for v in values:
        if anchor is None or abs(v - anchor) > tolerance:
            group, anchor = group + 1, v
        out.append(group)
    return out


def column_count(lefts: list[float], page_width: float, share: float = 0.08, least: int = 2) -> int:
    """Columns of a page: clusters of sorted lefts anchored at their first, of two members at least; one for under three blocks."""
    if len(lefts) < 3:
        return 1
    groups = anchored_groups(sorted(lefts), share * page_width)
    return max(1, sum(groups.count(g) >= least for g in set(groups)))


def online_bins(values: list[float], weights: list[float], tolerance: float) -> list[int]:
    """First-fit bins in input order; a bin's place is the weighted mean of what it holds."""
    centres: list[list[float]] = []
    out = []
    for v, w in zip(values, weights, strict=True):
        for i, (total, mass) in enumerate(centres):
            if abs(v - total / mass) <= tolerance:
                centres[i] = [total + v * w, mass + w]
                out.append(i + 1)
                break
        else:
            centres.append([v * w, w])
            out.append(len(centres))
    return out


# Shares of the page's width and multiples that make a gap a column gap.
EMPTY_SHARE, LEAST_SHARE, REGULAR_SHARE, WIDE_SHARE, MOST_SHARE = 0.10, 0.03, 0.02, 0.25, 0.25
FENCE, MOST_VARIATION, UNEVEN, PART_OF_LEAST = 1.5, 0.5, 3.0, 0.7


def gap_threshold(gaps: list[float], mean_width: float, page_width: float) -> float:
    """Gap from which two fragments of a line lie in different columns, by the shape of all the page's positive gaps.

    Wide fragments with gaps that vary little, quartile outliers aside, give a part
    of the least gap. Otherwise small gaps (words) and large ones (columns) are told
    apart at a share of the page: half-way between the two if there are
    enough large ones, below the large ones if there are no others, and by
    quartiles where all are small.
    """
    g = np.sort(np.asarray(gaps, float))
    n = len(g)
    if not n:
        return EMPTY_SHARE * page_width
    low, high = g[[min(n - 1, n // 4), min(n - 1, 3 * n // 4)]]
    held = lambda value, least: float(np.clip(value, least * page_width, MOST_SHARE * page_width))
    if n >= 8 and mean_width > WIDE_SHARE * page_width:
        usual = g[np.abs(g - (low + high) / 2) <= (FENCE + 0.5) * (high - low)]
        if len(usual) >= 5 and 0 < usual.mean() and usual.std(ddof=1) < MOST_VARIATION * usual.mean():
            return held(PART_OF_LEAST * usual[0], REGULAR_SHARE)
    split = int(np.searchsorted(g, LEAST_SHARE * page_width))  # small gaps before it, large ones from it on
    middle = np.median(g)
    if split == 0:
        return held(PART_OF_LEAST * g[0], LEAST_SHARE)
    if n - split >= 3:
        return held((g[split - 1] + g[split]) / 2, LEAST_SHARE)
    if n >= 5 and 0 < g[0] and g[-1] > UNEVEN * g[0]:
        by_quartiles = (3 * low, (low + middle) / 2)
    else:
        by_quartiles = (4 * high, 6 * middle)
    return held(max(*by_quartiles, 0.05 * page_width), LEAST_SHARE)


def page_lines(rows: list[tuple[float, float, float]], tolerance: float = 3.0) -> list[list[tuple[float, float]]]:
    """(baseline, left, width) -> for each line its (left, width), from left to right."""
    rows = sorted(rows, key=lambda r: r[0])
    lines: dict[int, list] = {}
    for g, (_, left, width) in zip(running_mean_groups([r[0] for r in rows], tolerance), rows, strict=True):
        lines.setdefault(g, []).append((left, width))
    return [sorted(line, key=lambda r: r[0]) for line in lines.values()]


def column_starts(rows: list[tuple[float, float, float]], page_width: float, least: int = 8, most: int = 4) -> list[float]:
    """Starts of a page's columns by lines that agree on them, else by clusters of lefts."""
    if not rows:
        return []
    leftmost = [min(r[1] for r in rows)]
    lines = page_lines(rows)
    gaps = [b[0] - (a[0] + a[1]) for line in lines for a, b in zip(line, line[1:], strict=False)]
    limit = gap_threshold([g for g in gaps if g > 0], sum(r[2] for r in rows) / len(rows), page_width) if len(rows) > 1 else 0.1 * page_width
    split = [[line[0][0], *(b[0] for a, b in zip(line, line[1:], strict=False) if b[0] - (a[0] + a[1]) > limit)] for line in lines]
    split = [s for s in split if len(s) > 1]
    counts: dict[int, int] = {}
    for s in split:
        counts[len(s)] = counts.get(len(s), 0) + 1
    chosen: list[list[float]] = []
    if len(split) >= least:
        ranked = sorted(counts.items(), key=lambda x: -x[1])
        first = min(ranked[0][0], most)
        options = [first, *(n for n, c in ranked[1:] if c >= least and n <= most)]
        chosen = next(([s for s in split if len(s) == n] for n in options if sum(len(s) == n for s in split) >= least), [])
    if chosen:
        merged: list[float] = []
        for x in sorted(sum(c) / len(chosen) for c in zip(*chosen, strict=True)):
            if not merged or x - merged[-1] >= 0.10 * page_width:
                merged.append(x)
        if len(merged) > 1:
            return merged
    lefts = sorted(r[1] for r in rows)
    clusters: list[list[float]] = []
    for x in lefts:
        if clusters and x - clusters[-1][-1] <= 0.05 * page_width:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    centres = [sum(c) / len(c) for c in clusters if len(c) >= max(15, 0.10 * len(rows))]
    kept: list[float] = []
    for x in sorted(centres):
        if not kept or x - kept[-1] >= 0.20 * page_width:
            kept.append(x)
    return kept[:most] if len(kept[:most]) > 1 else leftmost


def column_id(left: float, width: float, page_width: float, starts: list[float]) -> int:
    """0 for full width, else the column from 1."""
    if len(starts) <= 1:
        return 1
    if left <= 0.05 * page_width and left + width >= 0.95 * page_width:
        return 0
    if abs(left + width / 2 - page_width / 2) <= 0.15 * page_width:
        aligned = any(abs(left - s) <= 0.05 * page_width for s in starts)
        if not aligned or width >= 0.30 * page_width:
            return 0
    middles = [(a + b) / 2 for a, b in zip(starts, starts[1:], strict=False)]
    return 1 + sum(left >= m for m in middles)


def reading_blocks(baselines: list[float], columns: list[int]) -> list[int]:
    """Reading-order block of each fragment of a page.

    Lines go from top to bottom; a change of structure (full width, one column,
    several columns) begins a block. A stretch of several columns lasts until a
    full-width line, and is numbered column by column, what spans it last.
    """
    out = [0] * len(baselines)
    heights = sorted(set(baselines))
    at = {y: [i for i, b in enumerate(baselines) if b == y] for y in heights}
    block, before, k = 1, None, 0
    while k < len(heights):
        ids = at[heights[k]]
        kinds = {columns[i] for i in ids}
        several = len({c for c in kinds if c > 0}) > 1
        now = "full" if kinds == {0} else "several" if several else "one"
        if before not in (None, now):
            block += 1
        before = now
        if now != "several":
            for i in ids:
                out[i] = block
            k += 1
            continue
        end = k + 1
        while end < len(heights) and {columns[i] for i in at[heights[end]]} != {0}:
            end += 1
        region = [i for y in heights[k:end] for i in at[y]]
        present = sorted({columns[i] for i in region if columns[i] > 0})
        for n, c in enumerate(present):
            block += n > 0
            for i in region:
                if columns[i] == c:
                    out[i] = block
        if any(columns[i] == 0 for i in region):
            block += 1
            for i in region:
                if columns[i] == 0:
                    out[i] = block
        k = end
    return out


def repair_columns(columns: list[int], baselines: list[float], tolerance: float) -> list[int]:
    """Propagation passes over a page in reading order; each sees what the one before changed.

    A lone fragment between two of another column takes theirs; then, on one line,
    a full-width mark next to columnar fragments takes the nearest column.
    """
    out = list(columns)
    for i in range(1, len(out) - 1):
        if out[i - 1] == out[i + 1] != out[i] and out[i] != 0:
            out[i] = out[i - 1]
    groups = anchored_groups(baselines, tolerance)
    for i in range(len(out)):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(out) and groups[j] == groups[i] and out[j] > 0]
        if out[i] == 0 and len(near) == 2:
            out[i] = out[near[0]]
    return out


PUNCTUATION, BULLETS = set(".,;:!?)]}\"'…»›"), set("•●○■□▪▫·-*–—→⇒▸►")


def inline_runs(rows: list[tuple[str, float, float, float]], continues: set[str], tolerance: float = 5.0) -> list[int]:
    """Run numbers of a line's (text, left, width, height) from left to right: neighbours that are one phrase share a run.

    The gap is measured from the end of the run so far, which widens as it grows.
    """
    out, run, text, end, height = [], 0, "", 0.0, 0.0
    for t, left, width, h in rows:
        if run:
            gap, bare, low = left - end, t.strip(), text.lower().rstrip()
            joins = (
                bool(bare) and set(bare) <= PUNCTUATION | {" "} and gap <= 10.0
                or len(text.strip()) == 1 and text.strip() in BULLETS and gap <= 20.0
                or abs(gap) <= tolerance
                or t.startswith(" ") and abs(gap - 1.0) <= tolerance
                or 0 < gap < 0.5 * min(height, h)
                or 0 < gap <= 15.0 and low.endswith(tuple(continues) + tuple(c + "," for c in continues))
            )
            if joins:
                text, end, height = text + t, max(end, left + width), height
                out.append(run)
                continue
        run, text, end, height = run + 1, t, left + width, h
        out.append(run)
    return out


def heading_lines(sizes: list[float], tolerance: float = 1.0) -> list[int]:
    """Groups of consecutive lines whose size is within the tolerance of the group's first line."""
    return anchored_groups(sizes, tolerance)


def aligned_tables(rows: list[tuple[float, float, list[float]]], near: float = 25.0, factor: float = 1.8) -> list[int]:
    """Table number of each line (top, height, column lefts): two lines at least, as many columns, each within ``near``; 0 for none."""
    out, number, k = [0] * len(rows), 0, 0
    while k < len(rows):
        end = k + 1
        while end < len(rows):
            (top, height, cells), (_, _, first) = rows[end], rows[k]
            before = rows[end - 1]
            alike = len(cells) == len(first) > 1 and all(abs(a - b) <= near for a, b in zip(cells, first, strict=True))
            if not alike or top - before[0] > factor * max(height, before[1]):
                break
            end += 1
        if end - k >= 2:
            number += 1
            out[k:end] = [number] * (end - k)
            k = end
        else:
            k += 1
    return out


def table_chains(rows: list[tuple[int, int, bool]]) -> list[bool]:
    """(page, columns, marked as continued) of a document's tables: whether each is merged into the one before it.

    A pair merges if the second is marked, or on the next page with as many
    columns; a table just merged does not draw in a third.
    """
    out = [False] * len(rows)
    for k in range(1, len(rows)):
        (page, columns, _), (nxt, more, marked) = rows[k - 1], rows[k]
        if not out[k - 1] and (marked or nxt == page + 1 and columns == more > 0):
            out[k] = True
    return out


def list_levels(indents: list[int], pages: list[int]) -> list[int]:
    """Nesting of list items: two spaces a level; the first item of a page goes no deeper than one below the last of the page before."""
    out: list[int] = []
    for k, spaces in enumerate(indents):
        level = spaces // 2
        if k and pages[k] != pages[k - 1]:
            level = min(level, out[-1] + 1)
        out.append(level)
    return out


def merged_rects(rects: list[tuple[float, float, float, float]], distance: float = 20.0, rounds: int = 10) -> list[int]:
    """Group of each rectangle: rectangles that come within the distance grow together, in order, for so many rounds at most."""
    group = list(range(len(rects)))
    boxes = dict(enumerate(rects))
    for _ in range(rounds):
        changed = False
        for a in sorted(boxes):
            for b in sorted(boxes):
                if a < b and a in boxes and b in boxes:
                    p, q = boxes[a], boxes[b]
                    if p[0] - distance <= q[2] and q[0] - distance <= p[2] and p[1] - distance <= q[3] and q[1] - distance <= p[3]:
                        boxes[a] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
                        del boxes[b]
                        group = [a if g == b else g for g in group]
                        changed = True
        if not changed:
            break
    return group


def covered_rects(rects: list[tuple[float, float, float, float]], share: float = 0.5) -> list[int]:
    """Group of each rectangle: joined to the first before it of which it shares over half of the smaller's area."""
    out: list[int] = []
    for k, r in enumerate(rects):
        for j in range(k):
            q = rects[j]
            w, h = min(r[2], q[2]) - max(r[0], q[0]), min(r[3], q[3]) - max(r[1], q[1])
            small = min((r[2] - r[0]) * (r[3] - r[1]), (q[2] - q[0]) * (q[3] - q[1]))
            if w > 0 and h > 0 and w * h > share * small:
                out.append(out[j])
                break
        else:
            out.append(k)
    return out


def components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Smallest member reachable from each of n nodes."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


TERMINATORS = (".", "!", "?")


def paragraph_groups(rows: list[dict], base_gap: float | None = None) -> list[int]:
    """Paragraph of each fragment of a document in reading order; first rule that applies decides.

    Rows have page, col_id, block, top, height, left, width, font_size, bold, text.
    A fragment that joins across a column takes over the block of the one before,
    which the next comparison sees.
    """
    out, number, before = [], 0, None
    widths: dict[int, tuple[float, float]] = {}
    for r in rows:
        a, b = widths.get(r["col_id"], (r["left"], r["left"] + r["width"]))
        widths[r["col_id"]] = (min(a, r["left"]), max(b, r["left"] + r["width"]))

    def breaks(p: dict, c: dict) -> bool:
        text, nxt = p["text"].rstrip(), c["text"].lstrip()
        gap, most = c["top"] - (p["top"] + p["height"]), base_gap or (1.5 * p["height"] if p["height"] > 0 else 18.0)
        hyphen = text.endswith("-") and nxt[:1].islower()
        ended = text.endswith(TERMINATORS)
        span = widths[p["col_id"]]
        new_sentence = p["width"] < 0.95 * (span[1] - span[0]) and ended and nxt[:1].isupper()
        if p["page"] != c["page"]:
            return True
        if p["col_id"] != c["col_id"] or p["block"] != c["block"]:
            if hyphen or not ended and gap < most:
                c["block"] = p["block"]
                return False
            return True
        if abs(p["top"] - c["top"]) <= 3 and (p["text"].endswith((" ", "-")) or c["text"].startswith(" ")):
            return False
        if abs(p["font_size"] - c["font_size"]) >= 2.0 or p["bold"] != c["bold"]:
            return True
        if gap > most:
            return not hyphen
        if gap > 3:
            return p["left"] - c["left"] > 50 or new_sentence or gap > c["font_size"]
        return new_sentence

    for r in rows:
        r = dict(r)
        if before is None or breaks(before, r):
            number += 1
        out.append(number)
        before = r
    return out


LABELS = ("table", "figure", "toc", "toc_item", "glossary_item", "index_letter", "index_entry", "book_title", "part", "chapter", "front_matter", "section", "caption", "list_item", "para")


def block_labels(rows: list[dict]) -> list[str]:
    """Label of each entry of a document in flow order. Rows have kind, heading, text, font_size, is_noise, is_list, in_outline.

    One state at a time: the body, a table of contents, a glossary or an index;
    each begins at its heading and ends at a heading of at least that size.
    """
    out, state, size, titled = [], "body", 0.0, False
    for r in rows:
        heading, text = r["heading"], r["text"].strip()
        if r["kind"] in ("table", "figure"):
            out.append(r["kind"])
            continue
        if r["is_noise"] and not (state == "index" and len(text) == 1 and text.isupper()):
            out.append("")
            continue
        if state != "body" and heading and r["font_size"] >= size:
            state = "body"
        if state == "body" and heading in ("toc", "glossary", "index"):
            state, size = heading, r["font_size"]
            out.append("toc" if heading == "toc" else "section")
        elif state == "toc":
            out.append("toc_item")
        elif state == "glossary":
            out.append("glossary_item")
        elif state == "index":
            out.append("index_letter" if len(text) == 1 and text.isupper() else "index_entry")
        elif heading == "book_title" and not titled:
            titled = True
            out.append("book_title")
        elif heading == "part":
            out.append("part")
        elif heading in ("chapter", "book_title"):
            out.append("chapter" if r["in_outline"] else "section")
        elif heading in ("section", "caption"):
            out.append(heading)
        elif r["is_list"]:
            out.append("list_item")
        else:
            out.append("para")
    return out
