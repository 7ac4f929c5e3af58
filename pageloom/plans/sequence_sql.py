"""DuckDB SQL of operators that carry state from row to row: recursive CTEs over numbered rows, and the plain ones beside them."""

from __future__ import annotations

from ..operators.windows import CONTINUES, CONTINUES_FAR
from .adapters import BOXES_SQL, FRAGMENTS_SQL
from .documents import _LINES
from .layout import _FRAG, PAGE_H, PAGE_W
from .layout import ORACLE_SQL as LAYOUT_SQL

_COLUMNS = 'doc_id, page, stream_index, text, top, "left", width, height, font_size, bold, baseline, col_id, block'
_PAGE, _DOC = ("doc_id", "page"), ("doc_id",)


def _fold(order: str, start: str, step: str, value: str = "grp", keys: tuple[str, ...] = _PAGE, rows: str = "f", with_: str = _FRAG, columns: str = _COLUMNS, out: str = "grp") -> str:
    """``start`` gives the state of a group's first row ``o``, ``step`` that of row ``o`` after state ``s``; ``value`` is read from the state."""
    on = " AND ".join(f"o.{k} = s.{k}" for k in keys)
    names = ", ".join(keys)
    return f"""WITH RECURSIVE {with_}, o AS (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY {order}) AS rn FROM {rows}),
      s AS (SELECT {names}, rn, {start} FROM o WHERE rn = 1 UNION ALL SELECT {', '.join('o.' + k for k in keys)}, o.rn, {step} FROM s JOIN o ON {on} AND o.rn = s.rn + 1),
      made AS (SELECT o.*, {value} AS {out if out not in _COLUMNS.split(', ') else 'made_' + out} FROM o JOIN s ON {on} AND o.rn = s.rn)
      SELECT {columns}, {out} FROM made"""


def _anchored(x: str, tolerance: float) -> tuple[str, str]:
    joins = f"abs(o.{x} - s.anchor) <= {tolerance}"
    return f"CAST(1 AS BIGINT) AS grp, CAST({x} AS DOUBLE) AS anchor", f"s.grp + CASE WHEN {joins} THEN 0 ELSE 1 END, CASE WHEN {joins} THEN s.anchor ELSE o.{x} END"


_MEAN = "abs(o.baseline - s.total / s.n) <= 5"
_NUMBERED = f"""n AS (SELECT *, CASE WHEN n_chars % 3 = 0 THEN 'ordered' WHEN n_chars % 3 = 1 THEN 'itemized' END AS kind FROM f),
  c AS (SELECT *, coalesce(lag(kind) OVER w IS NULL OR kind IS DISTINCT FROM lag(kind) OVER w OR top - lag(top) OVER w > 2.5 * height OR abs("left" - lag("left") OVER w) > 15, false) AS cut FROM n WINDOW w AS (PARTITION BY doc_id, page ORDER BY stream_index)),
  r AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY stream_index) AS run FROM c)"""
_CLIP = "least(greatest({0}, {1}), 100.0)"
_SIZES = f"""z AS (SELECT doc_id, font_size, count(*) AS n, count(DISTINCT page) AS pages, min(stream_index) AS first FROM f WHERE font_size >= 4 AND trim(text) <> '' GROUP BY 1, 2),
  y AS (SELECT doc_id, font_size AS body_size FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
  st AS (SELECT z.*, body_size, font_size / CAST(body_size AS DOUBLE) AS ratio FROM z JOIN y USING (doc_id))"""
_LABEL_ROWS = """lr AS (SELECT doc_id, stream_index, trim(text) AS t, font_size, n_chars % 31 = 0 AS is_table, n_chars < 3 AS noise, n_chars % 11 = 0 AS is_list, page % 2 = 0 AS outlined,
  CASE WHEN font_size >= 15 THEN CASE WHEN stream_index % 7 = 0 THEN 'toc' WHEN stream_index % 5 = 0 THEN 'chapter' ELSE 'section' END END AS heading FROM f)"""
_CLOSED = "(s.state = 'toc' AND NOT (o.heading IS NOT NULL AND o.font_size >= s.size))"  # the contents go on
_SKIP = "(o.is_table OR o.noise)"


def _label(state_is_toc: str) -> str:
    return f"CASE WHEN o.is_table THEN 'table' WHEN o.noise THEN '' WHEN {state_is_toc} THEN 'toc_item' WHEN o.heading = 'toc' THEN 'toc' WHEN o.heading = 'chapter' THEN CASE WHEN o.outlined THEN 'chapter' ELSE 'section' END WHEN o.heading = 'section' THEN 'section' WHEN o.is_list THEN 'list_item' ELSE 'para' END"


_RULES = """h AS (SELECT l_orderkey // 8 AS page, CAST(l_partkey % 9 AS BIGINT) AS a, CAST(150 + l_suppkey % 90 AS BIGINT) AS b, CAST(l_linenumber * 20 AS BIGINT) AS y FROM lineitem),
  v AS (SELECT l_orderkey // 8 AS page, CAST(l_suppkey % 9 AS BIGINT) AS c, CAST(90 + l_partkey % 60 AS BIGINT) AS d, CAST(l_linenumber * 25 AS BIGINT) AS x FROM lineitem)"""
_REPAIRED = f"""o AS (SELECT *, row_number() OVER w AS rn, lead(col_id) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY doc_id, page ORDER BY baseline, stream_index)),
  p AS (SELECT doc_id, page, rn, col_id AS first_pass, CAST(1 AS BIGINT) AS line, CAST(baseline AS DOUBLE) AS anchor FROM o WHERE rn = 1
    UNION ALL SELECT o.doc_id, o.page, o.rn, CASE WHEN o.nxt IS NOT NULL AND p.first_pass = o.nxt AND o.nxt <> o.col_id AND o.col_id <> 0 THEN p.first_pass ELSE o.col_id END,
      p.line + CASE WHEN abs(o.baseline - p.anchor) <= 5 THEN 0 ELSE 1 END, CASE WHEN abs(o.baseline - p.anchor) <= 5 THEN p.anchor ELSE o.baseline END FROM p JOIN o ON o.doc_id = p.doc_id AND o.page = p.page AND o.rn = p.rn + 1),
  k AS (SELECT *, lead(first_pass) OVER w AS nxt, lead(line) OVER w AS nxt_line FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY rn)),
  q AS (SELECT doc_id, page, rn, line, first_pass AS made FROM k WHERE rn = 1
    UNION ALL SELECT k.doc_id, k.page, k.rn, k.line, CASE WHEN k.first_pass = 0 AND q.line = k.line AND q.made > 0 AND k.nxt_line = k.line AND k.nxt > 0 THEN q.made ELSE k.first_pass END FROM q JOIN k ON k.doc_id = q.doc_id AND k.page = q.page AND k.rn = q.rn + 1)"""
_COVER = f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box) - 1 AS k FROM boxes),
  first AS (SELECT b.page, b.k, min(a.k) AS j FROM o b JOIN o a ON a.page = b.page AND a.k < b.k AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
    AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY 1, 2),
  up AS (SELECT page, k, k AS at FROM o UNION ALL SELECT up.page, up.k, first.j FROM up JOIN first ON first.page = up.page AND first.k = up.at)
  SELECT o.page, o.box, min(up.at) AS grp FROM o JOIN up ON up.page = o.page AND up.k = o.k GROUP BY o.page, o.box, o.k"""

_SCRIPTS = """f2 AS (SELECT *, concat(doc_id, '-', page) AS pg, CAST(font_size AS VARCHAR) AS t, width % 20 AS w FROM f),
  near AS (SELECT a.pg, a.stream_index, b.stream_index AS parent, abs(a.top - b.top) AS off, CASE WHEN a."left" - (b."left" + b.w) BETWEEN 0 AND 5 THEN a."left" - (b."left" + b.w) WHEN b."left" - (a."left" + a.w) BETWEEN 0 AND 5 THEN b."left" - (a."left" + a.w) END AS gap
    FROM f2 a JOIN f2 b ON a.pg = b.pg AND a.w < 15 AND a.height < 14 AND length(a.t) BETWEEN 1 AND 3 AND a.height < 0.75 * b.height AND abs(a.top - b.top) <= 10),
  pa AS (SELECT pg, stream_index, parent FROM near WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pg, stream_index ORDER BY gap, off, parent) = 1)"""
_NOISE = r"\.indd\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)\b|^(?:[a-z0-9_\-]+\s+vi|vii|iv)$"
_PLACED = "round_even(top / 100.0, 2) AS y, round_even(\"left\" / 400.0, 2) AS x"
_ENDS_IN = "regexp_matches(lower(rtrim(before)), '(?:{0}),?$')"

_INLINE = (
    """(o.text ~ '^[ .,;:!?)\\\\]}"''…»›]*[.,;:!?)\\\\]}"''…»›][ .,;:!?)\\\\]}"''…»›]*$' AND o."left" - s.last <= 10 OR trim(s.words) IN ('•', '●', '○', '■', '□', '▪', '▫', '·', '-', '*', '–', '—', '→', '⇒', '▸', '►') AND o."left" - s.last <= 20 OR abs(o."left" - s.last) <= 5"""
    """ OR prefix(o.text, ' ') AND abs(o."left" - s.last - 1) <= 5 OR o."left" - s.last > 0 AND o."left" - s.last < 0.5 * least(s.tall, o.height) OR o."left" - s.last > 0 AND o."left" - s.last <= 15 AND regexp_matches(rtrim(lower(s.words)), '(?:"""
    + "|".join(CONTINUES) + "),?$'))"
).replace("\\\\", "\\")
_SAME = "o.col_id = s.col_id AND o.block = s.block"
_GAP, _MOST = "(o.top - (s.top + s.height))", "(1.5 * s.height)"
_HYPHEN, _ENDED = "(suffix(rtrim(s.text), '-') AND regexp_matches(ltrim(o.text), '^\\p{Ll}'))", "regexp_matches(rtrim(s.text), '[.!?]$')"
_NEW = f"(s.width < 0.95 * s.span AND {_ENDED} AND regexp_matches(ltrim(o.text), '^\\p{{Lu}}'))"
_BREAKS = f"""CASE WHEN o.page <> s.page THEN true WHEN NOT ({_SAME}) THEN NOT ({_HYPHEN} OR NOT {_ENDED} AND {_GAP} < {_MOST}) WHEN abs(s.top - o.top) <= 3 AND (suffix(s.text, ' ') OR suffix(s.text, '-') OR prefix(o.text, ' ')) THEN false
  WHEN abs(s.font_size - o.font_size) >= 2 OR s.bold <> o.bold THEN true WHEN {_GAP} > {_MOST} THEN NOT {_HYPHEN} WHEN {_GAP} > 3 THEN s."left" - o."left" > 50 OR {_NEW} OR {_GAP} > o.font_size ELSE {_NEW} END"""
_CARRIED = ("page", "text", "top", "height", '"left"', "width", "font_size", "bold", "col_id", "span")

ORACLE_SQL = {
    "win_02_lines": _fold("baseline, stream_index", "CAST(1 AS BIGINT) AS grp, CAST(baseline AS DOUBLE) AS total, 1 AS n", f"s.grp + CASE WHEN {_MEAN} THEN 0 ELSE 1 END, CASE WHEN {_MEAN} THEN s.total + o.baseline ELSE o.baseline END, CASE WHEN {_MEAN} THEN s.n + 1 ELSE 1 END"),
    "win_03_anchored": _fold("baseline, stream_index", *_anchored("baseline", 5)),
    "win_29_headings": _fold("stream_index", *_anchored("font_size", 1)),
    "win_05_column_count": _fold('"left", stream_index', *_anchored('"left"', 32)).replace(f"SELECT {_COLUMNS}, grp FROM made", f"SELECT {_COLUMNS}, n_columns AS grp FROM f JOIN (SELECT doc_id, page, CASE WHEN sum(n) < 3 THEN 1 ELSE greatest(1, count(*) FILTER (n >= 2)) END AS n_columns FROM (SELECT doc_id, page, grp, count(*) AS n FROM made GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (doc_id, page)"),
    "win_06_bins": _fold(
        "stream_index", 'CAST(1 AS BIGINT) AS grp, [{\'t\': CAST("left" * greatest(1, width) AS DOUBLE), \'m\': CAST(greatest(1, width) AS DOUBLE)}] AS c',
        "CAST(x.at AS BIGINT), CASE WHEN x.at > len(s.c) THEN list_append(s.c, x.mine) ELSE list_transform(s.c, lambda e, i: CASE WHEN i = x.at THEN {'t': e.t + x.mine.t, 'm': e.m + x.mine.m} ELSE e END) END",
    ).replace("o.rn = s.rn + 1)", """o.rn = s.rn + 1, LATERAL (SELECT coalesce(nullif(list_position(list_transform(s.c, lambda e: abs(o."left" - e.t / e.m) <= 25), true), 0), len(s.c) + 1) AS at, {'t': CAST(o."left" * greatest(1, o.width) AS DOUBLE), 'm': CAST(greatest(1, o.width) AS DOUBLE)} AS mine) x)"""),
    "win_08_gap": f"""WITH {_FRAG}, a AS (SELECT doc_id, page, coalesce(list(CAST("left" AS DOUBLE) ORDER BY "left") FILTER ("left" > 0), []) AS g, avg(width) AS w FROM f GROUP BY 1, 2),
      b AS (SELECT *, len(g) AS n, g[least(len(g) - 1, len(g) // 4) + 1] AS low, g[least(len(g) - 1, 3 * len(g) // 4) + 1] AS high, list_median(g) AS middle, len(list_filter(g, lambda x: x < 0.03 * {PAGE_W})) AS split FROM a),
      u AS (SELECT *, CASE WHEN n >= 8 AND w > 0.25 * {PAGE_W} THEN list_filter(g, lambda x: abs(x - (low + high) / 2) <= 2 * (high - low)) ELSE [] END AS usual FROM b),
      t AS (SELECT doc_id, page, CASE WHEN n = 0 THEN 0.1 * {PAGE_W} WHEN len(usual) >= 5 AND list_avg(usual) > 0 AND list_stddev_samp(usual) < 0.5 * list_avg(usual) THEN {_CLIP.format('0.7 * usual[1]', '8.0')}
        WHEN split = 0 THEN {_CLIP.format('0.7 * g[1]', '12.0')} WHEN n - split >= 3 THEN {_CLIP.format('(g[split] + g[split + 1]) / 2', '12.0')}
        WHEN n >= 5 AND g[n] > 3 * g[1] THEN {_CLIP.format('greatest(3 * low, (low + middle) / 2, 20.0)', '12.0')} ELSE {_CLIP.format('greatest(4 * high, 6 * middle, 20.0)', '12.0')} END AS grp FROM u)
      SELECT {_COLUMNS}, CAST(grp AS DOUBLE) AS grp FROM f JOIN t USING (doc_id, page)""",
    "win_12_repair": f"WITH RECURSIVE {_FRAG}, {_REPAIRED} SELECT {_COLUMNS}, CAST(made AS BIGINT) AS grp FROM o JOIN q USING (doc_id, page, rn)",
    "win_30_tables": _fold(
        "top, stream_index", 'CAST(1 AS BIGINT) AS run, "left" AS anchor, top AS last_top, height AS last_height',
        's.run + CASE WHEN abs(o."left" - s.anchor) <= 25 AND o.top - s.last_top <= 1.8 * greatest(o.height, s.last_height) THEN 0 ELSE 1 END, CASE WHEN abs(o."left" - s.anchor) <= 25 AND o.top - s.last_top <= 1.8 * greatest(o.height, s.last_height) THEN s.anchor ELSE o."left" END, o.top, o.height',
        "run",
    ).replace(f"SELECT {_COLUMNS}, grp FROM made", f"SELECT {_COLUMNS}, CASE WHEN n >= 2 THEN CAST(number AS BIGINT) ELSE 0 END AS grp FROM made JOIN (SELECT *, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY grp) AS number FROM (SELECT doc_id, page, grp, count(*) AS n FROM made GROUP BY 1, 2, 3)) USING (doc_id, page, grp)"),
    "win_21_tables": _fold("stream_index", "false AS merged, page AS last_page, n_chars % 4 AS wide", "NOT s.merged AND (o.n_chars % 9 = 0 OR o.page = s.last_page + 1 AND s.wide = o.n_chars % 4 AND s.wide > 0), o.page, o.n_chars % 4", "merged", _DOC, columns="doc_id, page, stream_index, n_chars", out="merged"),
    "win_22_list_levels": _fold("stream_index", "CAST(n_chars % 9 // 2 AS BIGINT) AS level, page AS last_page", "CASE WHEN o.page <> s.last_page THEN least(o.n_chars % 9 // 2, s.level + 1) ELSE o.n_chars % 9 // 2 END, o.page", "level", _DOC, columns="doc_id, page, stream_index, n_chars", out="level"),
    "win_28_lists": f"WITH {_FRAG}, {_NUMBERED} SELECT doc_id, stream_index, kind IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, page, run ORDER BY stream_index ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) >= CASE WHEN kind = 'itemized' THEN 1 ELSE 2 END AS confirmed FROM r",
    "win_34_labels": _fold(
        "stream_index", f"CASE WHEN NOT {_SKIP.replace('o.', '')} AND heading = 'toc' THEN 'toc' ELSE 'body' END AS state, CASE WHEN NOT {_SKIP.replace('o.', '')} AND heading = 'toc' THEN font_size ELSE 0 END AS size, {_label('false').replace('o.', '')} AS label",
        f"CASE WHEN {_SKIP} THEN s.state WHEN {_CLOSED} THEN 'toc' WHEN o.heading = 'toc' THEN 'toc' ELSE 'body' END, CASE WHEN {_SKIP} OR {_CLOSED} THEN s.size WHEN o.heading = 'toc' THEN o.font_size ELSE s.size END, {_label(_CLOSED)}",
        "label", _DOC, "lr", f"{_FRAG}, {_LABEL_ROWS}", "doc_id, stream_index", "label",
    ),
    "graph_03_cover": _COVER,
    "agg_15_sizes": f"WITH {_FRAG}, {_SIZES} SELECT CASE WHEN ratio >= 1.5 THEN 'title' WHEN ratio >= 1.3 THEN 'chapter' WHEN ratio >= 1.15 THEN 'section' WHEN ratio >= 1.05 THEN 'subsection' ELSE 'body' END AS role, CAST(sum(n) AS BIGINT) AS n, min(doc_id) AS first_doc FROM st GROUP BY 1",
    "agg_16_tiers": f"WITH {_FRAG}, {_SIZES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS place, font_size >= greatest(body_size + 1, 1.2 * body_size) AS heading FROM st) SELECT doc_id, font_size, CASE WHEN font_size = body_size THEN 'body' WHEN heading AND place = 1 THEN 'title' WHEN heading AND place <= 7 AND n >= 2 THEN 'chapter' WHEN font_size >= greatest(body_size + 0.5, 1.1 * body_size) THEN 'section' WHEN font_size >= greatest(body_size, 1.05 * body_size) THEN 'subsection' ELSE 'body' END AS tier FROM p",
    "agg_25_grids": f"""WITH {_RULES}, box AS (SELECT page, min(a) AS x0, max(b) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS nh FROM h GROUP BY 1),
      span AS (SELECT page, count(*) FILTER (b - a >= 0.6 * (x1 - x0)) AS sh FROM h JOIN box USING (page) GROUP BY 1), tall AS (SELECT page, count(*) FILTER (d - c >= 0.5 * (y1 - y0)) AS sv, count(*) AS nv FROM v JOIN box USING (page) GROUP BY 1),
      met AS (SELECT h.page, count(*) AS crossings FROM h JOIN v ON h.page = v.page AND x BETWEEN a - 5 AND b + 5 AND y BETWEEN c - 5 AND d + 5 GROUP BY 1)
      SELECT page, x0, y0, x1, y1, crossings FROM box JOIN span USING (page) JOIN tall USING (page) JOIN met USING (page) WHERE x1 - x0 >= 100 AND y1 - y0 >= 50 AND nh >= 5 AND nv >= 4 AND sh >= 4 AND sv >= 3 AND crossings >= 12 AND crossings >= 0.7 * nh * nv""",
    "arr_01_distinct": "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY p, l_returnflag) AS kinds FROM (SELECT l_orderkey, l_returnflag, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "flt_06_spines": f"WITH {_FRAG} SELECT doc_id, stream_index, length(CAST(font_size AS VARCHAR)) <= 3 AND \"left\" * 8 > {PAGE_W} * 0.8 AND height > width % 9 * 2 AS spine FROM f",
    "flt_18_rtl": "SELECT doc_id, coalesce(length(regexp_replace(text, '\\s+', '', 'g')) >= 50 AND len(regexp_extract_all(text, '[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]')) >= 0.15 * length(regexp_replace(text, '\\s+', '', 'g')), false) AS rtl FROM documents",
    "ext_03_aligned": f"""WITH {_FRAG}, x AS (SELECT doc_id, page, count(*) AS c FROM (SELECT doc_id, page, round_even("left" / 10.0, 0) AS v FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2), y AS (SELECT doc_id, page, count(*) AS r FROM (SELECT doc_id, page, round_even(top / 10.0, 0) AS v FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2)
      SELECT doc_id, page, coalesce(c, 0) >= 2 AND coalesce(r, 0) >= 2 AS is_table FROM (SELECT DISTINCT doc_id, page FROM f) LEFT JOIN x USING (doc_id, page) LEFT JOIN y USING (doc_id, page)""",
    "ext_16_toc": f"""WITH {_FRAG}, t AS (SELECT doc_id, page, stream_index, font_size, CASE WHEN stream_index = 2 THEN 'Contents' ELSE text END AS text FROM f),
      h AS (SELECT doc_id, page AS hp, font_size AS hs, stream_index AS start FROM t WHERE lower(trim(text)) IN ('contents', 'table of contents') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stream_index) = 1),
      e AS (SELECT t.doc_id, min(stream_index) AS stop FROM t JOIN h ON h.doc_id = t.doc_id AND page > hp AND font_size >= hs AND length(trim(text)) > 3 AND NOT regexp_matches(trim(text), '^[0-9]+$') AND stream_index > start GROUP BY 1)
      SELECT t.doc_id, stream_index FROM t JOIN h USING (doc_id) LEFT JOIN e USING (doc_id) WHERE stream_index >= start AND stream_index < coalesce(stop, 2147483648)""",
    "ext_20_boundaries": f"""WITH {_FRAG}, t AS (SELECT doc_id, page, stream_index, top * 4 AS top, height FROM f), m AS (SELECT doc_id, page, list(height ORDER BY height) FILTER (height > 0) AS hs FROM t GROUP BY 1, 2),
      n AS (SELECT *, lead(top) OVER (PARTITION BY doc_id, page ORDER BY top, stream_index) AS nxt FROM t)
      SELECT doc_id, page, top + height AS y FROM n JOIN m USING (doc_id, page) WHERE nxt - (top + height) > 1.5 * coalesce(hs[len(hs) // 2 + 1], 12)""",
    "snk_04_validation": f"WITH {_LINES}, e AS (SELECT 'type' AS facet, 'Invalid Content Model' AS key, count(*) AS n FROM g UNION ALL SELECT 'type', 'Missing Attribute', CAST(sum(a) AS BIGINT) FROM g UNION ALL SELECT 'type', 'Broken Link', CAST(sum(a) AS BIGINT) FROM g UNION ALL SELECT 'file', concat('c', chapter % 10), CAST(sum(1 + 2 * a) AS BIGINT) FROM g GROUP BY 2 UNION ALL SELECT 'severity', 'Error', CAST(sum(1 + 2 * a) AS BIGINT) FROM g UNION ALL SELECT 'severity', 'Warning', 0 UNION ALL SELECT 'severity', 'Info', 0) SELECT * FROM e WHERE n > 0 OR facet = 'severity'",
    "src_12_layout": f"WITH {FRAGMENTS_SQL} SELECT doc_id, page, concat('t', stream_index) AS text, CAST(top AS DOUBLE) AS top, CAST(\"left\" AS DOUBLE) AS \"left\", CAST(top + height AS DOUBLE) AS baseline FROM frag",
    "src_11_files": "SELECT 'file=9780' AS isbn, 'other' AS file_type UNION ALL SELECT 'file=9781', 'other'",
    "xml_03_edits": "SELECT fix, kind, n * (SELECT count(*) FROM nation) AS n FROM (VALUES ('fix_13_excluded', 'unwrap', 1), ('fix_13_excluded', 'remove', 1), ('fix_03_figures', 'imagedata', 1), ('fix_06_paragraphs', 'nested para', 1)) v(fix, kind, n)",
    "join_16_scripts": f"WITH {_FRAG}, {_SCRIPTS} SELECT pg AS page, stream_index, parent FROM pa",
    "win_36_scripts": f"""WITH {_FRAG}, {_SCRIPTS}, k AS (SELECT a.pg, a.stream_index, pa.parent, a.top - b.top AS diff, a.top, a.height, b.baseline AS base, a.t, b.t AS x FROM pa JOIN f2 a ON a.pg = pa.pg AND a.stream_index = pa.stream_index JOIN f2 b ON b.pg = pa.pg AND b.stream_index = pa.parent),
      m AS (SELECT *, CASE WHEN diff BETWEEN -3 AND 2 OR diff < 3 AND top + height <= base + 2 THEN 'superscript' WHEN diff BETWEEN 3 AND 10 OR diff >= 3 AND top >= base - 2 THEN 'subscript' END AS script FROM k)
      SELECT pg AS page, stream_index, parent, script, concat(x, CASE script WHEN 'superscript' THEN '^' ELSE '_' END, t) AS merged_text FROM m WHERE script IS NOT NULL""",
    "flt_04_noise": f"WITH {_FRAG}, t AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM f) SELECT doc_id, stream_index, top > 105 OR top < -20 OR regexp_matches(t, '{_NOISE}') OR height < 6 OR (top < 12 OR top > 85) AND (n_chars % 5 = 0 OR regexp_matches(t, '^(?:[0-9]{{1,4}}|[ivxlcdm]+)$')) AS noise FROM t",
    "win_17_pages": f"""WITH {_FRAG}, l AS (SELECT doc_id, page, text, col_id FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY baseline DESC, stream_index) = 1),
      s AS (SELECT doc_id, page, text, col_id FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY baseline, stream_index) = 1),
      n AS (SELECT doc_id, page, rtrim(l.text, ' ') AS a, l.col_id AS c, ltrim(lead(s.text) OVER w, ' ') AS b, lead(s.col_id) OVER w AS e FROM l JOIN s USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id ORDER BY page))
      SELECT doc_id, page, coalesce(a <> '' AND b <> '' AND NOT (regexp_matches(a, '[.!?:;]$') AND NOT suffix(a, '...')) AND NOT (length(b) <= 50 AND regexp_matches(b, '^\\p{{Lu}}+$')) AND NOT (length(b) > 2 AND regexp_matches(b, '^\\p{{Lu}}\\s*\\.')) AND (c = 0) = (e = 0), false) AS merges FROM n""",
    "win_16_continues": f"""WITH {_FRAG}, w AS (SELECT *, lag(text) OVER o AS before, abs("left" - (lag("left") OVER o + lag(width) OVER o)) AS gap, lag(block) OVER o AS last_block FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY stream_index))
      SELECT doc_id, stream_index, coalesce(last_block = block AND (suffix(before, ' ') OR prefix(text, ' ') OR suffix(before, '-') OR CASE WHEN gap <= 5 THEN regexp_matches(text, '^[,.;:!?)\\]}}]') OR regexp_matches(before, '[(\\[{{]$') OR {_ENDS_IN.format('|'.join(CONTINUES))} OR regexp_matches(text, '^\\p{{Lu}}') AND gap <= 2 WHEN gap <= 15 THEN {_ENDS_IN.format('|'.join(CONTINUES_FAR))} ELSE false END), false) AS continues FROM w""",
    "agg_18_headers": f"""WITH {_FRAG}, p AS (SELECT doc_id, max(page) + 1 AS n_pages FROM f GROUP BY 1), t AS (SELECT doc_id, concat('header ', stream_index % 2) AS t, {_PLACED} FROM f),
      n AS (SELECT doc_id, t, count(*) AS n FROM t WHERE y < 0.12 OR y > 0.88 GROUP BY doc_id, t, round_even(y, 1), round_even(x, 1))
      SELECT doc_id, t AS norm_text, max(n) AS n FROM n JOIN p USING (doc_id) WHERE n >= CASE WHEN n_pages >= 500 THEN greatest(10, n_pages // 100) ELSE greatest(3, n_pages // 10) END GROUP BY 1, 2""",
    "agg_17_repeated": f"""WITH {_FRAG}, t AS (SELECT doc_id, page, concat('Running header ', page) AS t, {_PLACED} FROM f),
      g AS (SELECT doc_id, y, x, count(*) AS n, count(*) FILTER (y < 0.12 OR y > 0.88) AS z, count(DISTINCT t) AS k, max(page) - min(page) AS span FROM t GROUP BY 1, 2, 3)
      SELECT DISTINCT doc_id, t AS text FROM t JOIN g USING (doc_id, y, x) WHERE n >= 3 AND z >= 2 AND (k = 1 AND z >= 3 OR k >= 2 AND span <= 3 * k)""",
    "ext_17_lines": _fold('top, "left", stream_index', *_anchored("top", 2)).replace(f"SELECT {_COLUMNS}, grp FROM made", "SELECT doc_id, count(*) AS lines, max(size) AS largest FROM (SELECT doc_id, page, grp, max(font_size) AS size FROM made GROUP BY 1, 2, 3 HAVING bool_or(regexp_matches(text, '[^ \\t\\n\\r]'))) GROUP BY 1"),
    "ext_22_segments": f"WITH {_FRAG}, c AS (SELECT doc_id, coalesce(lag(bold) OVER w = bold AND lag(font_size) OVER w = font_size, false) AS same FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY stream_index)) SELECT doc_id, count(*) FILTER (NOT same) AS runs, count(*) AS fragments FROM c GROUP BY 1",
    "ext_24_preprocess": f'WITH {_FRAG} SELECT doc_id, count(*) AS n, CAST(max(page * {PAGE_H} + top) AS DOUBLE) AS lowest FROM (SELECT DISTINCT doc_id, page, top, "left", width, height, text FROM f) GROUP BY 1',
    "ext_13_panels": f"WITH {BOXES_SQL} SELECT page, component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS panels FROM ({LAYOUT_SQL['graph_01_components']}) JOIN (SELECT DISTINCT * FROM boxes) USING (page, box) GROUP BY 1, 2 HAVING count(*) >= 2",
    "snk_02_lines": f"""WITH {_FRAG}, c AS (SELECT concat(doc_id, '-', page, '-', baseline) AS line, stream_index % 6 AS col, string_agg(text, ' ' ORDER BY "left", text) AS t FROM f GROUP BY 1, 2)
      SELECT line, CAST(length(coalesce(string_agg(t, ' | ' ORDER BY col, t) FILTER (col >= 4), '')) AS INTEGER) AS n FROM c GROUP BY 1""",
    "win_14_inline": _fold('"left", stream_index', 'CAST(1 AS BIGINT) AS grp, text AS words, "left" + width AS last, height AS tall', f'CASE WHEN {_INLINE} THEN s.grp ELSE s.grp + 1 END, CASE WHEN {_INLINE} THEN concat(s.words, o.text) ELSE o.text END, CASE WHEN {_INLINE} THEN greatest(s.last, o."left" + o.width) ELSE o."left" + o.width END, CASE WHEN {_INLINE} THEN s.tall ELSE o.height END'),
    "win_15_paragraphs": _fold(
        "stream_index", "CAST(1 AS BIGINT) AS grp, block, " + ", ".join(_CARRIED), f"s.grp + CASE WHEN {_BREAKS} THEN 1 ELSE 0 END, CASE WHEN o.page = s.page AND NOT ({_SAME}) AND ({_HYPHEN} OR NOT {_ENDED} AND {_GAP} < {_MOST}) THEN s.block ELSE o.block END, " + ", ".join("o." + c for c in _CARRIED),
        "s.grp", _DOC, "spans", f"""{_FRAG}, spans AS (SELECT *, max("left" + width) OVER (PARTITION BY doc_id, col_id) - min("left") OVER (PARTITION BY doc_id, col_id) AS span FROM f)""",
    ),
    "flt_05_footers": f"""WITH {_FRAG}, t AS (SELECT *, trim(text) AS t, lower(trim(text)) AS low, prefix(lower(trim(text)), 'copyright') OR contains(text, '©') OR contains(lower(text), '(c)') AS c FROM f), k AS (SELECT doc_id, text, min(stream_index) AS first FROM t WHERE c AND page_num <= 5 GROUP BY 1, 2)
      SELECT doc_id, stream_index, CASE WHEN t = '' THEN true WHEN c THEN NOT coalesce(stream_index = first, false) ELSE (regexp_matches(t, '^[0-9]{{1,4}}$') OR regexp_matches(t, '(?i)^[ivxlcdm]+$') AND length(t) <= 5) AND (top < 8 OR top > 90)
        OR regexp_matches(low, '[0-9]{{3,}}-[0-9]{{3,}}.*\\.(?:indd|qxd)|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\\s+[0-9]{{1,2}}:[0-9]{{2}}|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$|^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$') OR regexp_matches(low, '\\(continued\\)|continued on|continued from|\\(cont\\.?\\)')
        OR regexp_matches(low, '^page\\s+[0-9]+(?:\\s+of\\s+[0-9]+)?$') OR length(t) <= 25 AND (top < 10 OR top > 88) AND ("left" < 60 OR "left" > 320) AND font_size < 16 OR regexp_matches(t, '^[0-9]{{1,4}}$') AND top > 85
        OR regexp_matches(low, 'isbn[-:\\s]*[0-9]|published by|all rights reserved|printed in') AND top > 80 END AS is_footer FROM t LEFT JOIN k USING (doc_id, text)""",
    "ext_09_trim": f"""WITH RECURSIVE {BOXES_SQL}, a AS (SELECT *, row_number() OVER () AS id FROM boxes WHERE kind = 'R'), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box, x0, y0, x1, y1) AS k FROM boxes WHERE kind = 'N'),
      s AS (SELECT page, box, id, x0, x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1, 0 AS k FROM a
        UNION ALL SELECT s.page, s.box, s.id, s.x0, s.x1, CASE WHEN h AND b.y0 < s.y0 + 0.3 * (s.y1 - s.y0) THEN greatest(s.y0, b.y1 + 5.0) ELSE s.y0 END,
          CASE WHEN h AND NOT b.y0 < s.y0 + 0.3 * (s.y1 - s.y0) AND b.y1 > s.y1 - 0.3 * (s.y1 - s.y0) THEN least(s.y1, b.y0 - 5.0) ELSE s.y1 END, b.k
        FROM s JOIN b ON b.page = s.page AND b.k = s.k + 1, LATERAL (SELECT b.x0 < s.x1 AND s.x0 < b.x1 AND b.y0 < s.y1 AND s.y0 < b.y1 AS h) hit)
      SELECT page, box, y0, y1 FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""",
    "ext_04_line_tables": f"""WITH {_RULES}, hi AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY page ORDER BY a) <= 5 THEN 0 ELSE 1 END AS n FROM h)),
      vi AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY c ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY page ORDER BY c) <= 5 THEN 0 ELSE 1 END AS n FROM v)),
      x AS (SELECT page, min(a) AS x0, max(b) AS x1 FROM (SELECT page, g, min(a) AS a, max(b) AS b FROM hi GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1), y AS (SELECT page, min(c) AS y0, max(d) AS y1 FROM (SELECT page, g, min(c) AS c, max(d) AS d FROM vi GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
      SELECT page, x0, x1, y0, y1 FROM x JOIN y USING (page) WHERE x1 - x0 > 50 AND y1 - y0 > 30""",
}
