"""Markup: node tables, rule checks, tree rewrites and conversions of whole chapters.

A chapter is one row's XML text. Rewrites are functions on a parsed tree that
return a log; ``rewrite`` applies a chain of them to every row in one Arrow pass
and returns the new text with its log. Internal entities are never expanded: a
DOCTYPE is cut off before parsing.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# ---- fixed values: element names of the document type -------------------------------------------
SECTIONS = ("sect1", "sect2", "sect3", "sect4", "sect5")
TITLED = ("chapter", "appendix", "preface", "part", "glossary", "bibliography", *SECTIONS, "figure", "table", "example")
MEDIA = ("mediaobject", "imageobject", "imagedata", "inlinemediaobject")
EXCLUDED = {"html": "unwrap", "body": "unwrap", "div": "unwrap", "span": "unwrap", "font": "unwrap", "center": "unwrap", "script": "remove", "style": "remove", "br": "remove", "hr": "remove"}
RETAGGED = {"b": "emphasis", "strong": "emphasis", "i": "emphasis", "em": "emphasis", "p": "para", "ul": "itemizedlist", "ol": "orderedlist", "li": "listitem", "sup": "superscript", "sub": "subscript", "code": "literal", "info": "bookinfo"}
REQUIRED = {"tgroup": ("cols",), "imagedata": ("fileref",), "ulink": ("url",), "link": ("linkend",), "xref": ("linkend",)}
MAY_HOLD = {"itemizedlist": {"title", "listitem"}, "orderedlist": {"title", "listitem"}, "table": {"title", "tgroup", "textobject"}, "tgroup": {"colspec", "thead", "tbody", "tfoot"}, "row": {"entry"}, "mediaobject": {"imageobject", "textobject", "caption"}}
# -------------------------------------------------------------------------------------------------
_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", re.S)
_STRAY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")


def parse(xml: str | None) -> ET.Element | None:
    """The tree, without DOCTYPE; undeclared entities become text. Null for what is no XML."""
    try:
        return ET.fromstring(_STRAY.sub("&amp;", _DOCTYPE.sub("", xml or "")))
    except ET.ParseError:
        return None


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def text_of(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def links_up(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {c: p for p in root.iter() for c in p}


# ---- tree edits ----
def remove(parent: ET.Element, child: ET.Element) -> None:
    """Take a child out; the text behind it stays."""
    at = list(parent).index(child)
    if child.tail:
        if at:
            parent[at - 1].tail = (parent[at - 1].tail or "") + child.tail
        else:
            parent.text = (parent.text or "") + child.tail
    parent.remove(child)


def unwrap(parent: ET.Element, child: ET.Element) -> None:
    """Put a child's content in its place."""
    at = list(parent).index(child)
    for lead in (child.text,):
        if lead:
            if at:
                parent[at - 1].tail = (parent[at - 1].tail or "") + lead
            else:
                parent.text = (parent.text or "") + lead
    inner = list(child)
    if child.tail:
        if inner:
            inner[-1].tail = (inner[-1].tail or "") + child.tail
        elif at:
            parent[at - 1].tail = (parent[at - 1].tail or "") + child.tail
        else:
            parent.text = (parent.text or "") + child.tail
    parent.remove(child)
    for k, x in enumerate(inner):
        parent.insert(at + k, x)


def wrap(parent: ET.Element, child: ET.Element, tag: str) -> ET.Element:
    """A new element around a child."""
    at = list(parent).index(child)
    box = ET.Element(tag)
    box.tail, child.tail = child.tail, None
    parent.remove(child)
    box.append(child)
    parent.insert(at, box)
    return box


def move(child: ET.Element, old: ET.Element, new: ET.Element) -> None:
    remove(old, child)
    child.tail = None
    new.append(child)


def rebuilt(root: ET.Element, judge: Callable[[ET.Element, ET.Element], str | None]) -> list[tuple[str, ET.Element]]:
    """Remove or unwrap children by ``judge(parent, child)``, from the leaves up in one walk; what was done.

    Texts around a child stay. An element is judged when its own children are
    settled, so one that is emptied on the way is judged as empty. Each list of
    children is built once, whatever the number of those that go.
    """
    done: list[tuple[str, ET.Element]] = []
    for e in reversed(list(root.iter())):
        verdicts = [judge(e, c) for c in e]
        if not any(verdicts):
            continue
        kept: list[ET.Element] = []
        pieces: dict[int, list[str]] = {0: [e.text or ""]}  # texts behind so many kept children
        for c, how in zip(list(e), verdicts, strict=True):
            if how is None:
                kept.append(c)
                pieces[len(kept)] = [c.tail or ""]
                continue
            done.append((how, c))
            if how == "unwrap":
                pieces[len(kept)].append(c.text or "")
                for inner in c:
                    kept.append(inner)
                    pieces[len(kept)] = [inner.tail or ""]
            pieces[len(kept)].append(c.tail or "")
        e.text = "".join(pieces[0]) or None
        for k, c in enumerate(kept):
            c.tail = "".join(pieces[k + 1]) or None
        e[:] = kept
    return done


def prune(root: ET.Element, empty: Callable[[ET.Element], bool]) -> int:
    """Remove elements for which ``empty`` holds, from the leaves up, until none is left."""
    return len(rebuilt(root, lambda parent, child: "remove" if empty(child) else None))


# ---- rewrites, in the order in which the chain applies them ----
def add_titles(root, log):
    for e in root.iter():
        if local(e) in TITLED and not any(local(c) in ("title", "info") for c in e):
            title = ET.Element("title")
            title.text = e.get("id") or local(e).capitalize()
            e.insert(0, title)
            log.append(("title", local(e)))


def formalise(root, log):
    """informalfigure and informaltable with a title are formal ones."""
    for e in root.iter():
        if local(e) in ("informalfigure", "informaltable") and any(local(c) == "title" for c in e):
            e.tag = local(e).removeprefix("informal")
            log.append(("formal", e.tag))


def figure_model(root, log):
    """Image data stand in a media object, figures hold a title first."""
    for p in list(root.iter()):
        for c in list(p):
            if local(c) == "imagedata" and local(p) != "imageobject":
                wrap(p, wrap(p, c, "imageobject"), "mediaobject")
                log.append(("imagedata", local(p)))
    for e in root.iter():
        if local(e) == "figure":
            titles = [c for c in e if local(c) == "title"]
            if titles and e[0] is not titles[0]:
                move(titles[0], e, e)
                e.insert(0, e[-1])
                del e[-1]
                log.append(("figure", "title first"))


def section_levels(root, log):
    def go(e, depth):
        for c in e:
            if local(c) == "section":
                c.tag = SECTIONS[min(depth, 4)]
                log.append(("section", c.tag))
            go(c, depth + (local(c) in SECTIONS))

    go(root, 0)


def cals_tables(root, log):
    """HTML rows and cells in tables as tgroup, row and entry."""
    for t in root.iter():
        rows = [r for r in t.iter() if local(r) == "tr"] if local(t) in ("table", "informaltable") else []
        if rows:
            group = ET.Element("tgroup", cols=str(max(len(r) for r in rows) or 1))
            body = ET.SubElement(group, "tbody")
            for r in rows:
                row = ET.SubElement(body, "row")
                for c in r:
                    entry = ET.SubElement(row, "entry")
                    entry.text, entry[:] = c.text, list(c)
            for c in [c for c in t if local(c) not in ("title", "caption")]:
                t.remove(c)
            t.append(group)
            log.append(("cals", str(len(rows))))


def flat_paragraphs(root, log):
    """A paragraph inside a paragraph gives its content up."""
    done = rebuilt(root, lambda parent, child: "unwrap" if local(parent) == local(child) == "para" else None)
    log.extend([("nested para", "")] * len(done))


def bridgeheads(root, log):
    """A bridgehead and what follows it, up to the next, become a section."""
    for p in list(root.iter()):
        heads = [c for c in p if local(c) == "bridgehead"]
        if not heads:
            continue
        level = SECTIONS[min(SECTIONS.index(local(p)) + 1, 4)] if local(p) in SECTIONS else "sect1"
        now, kept = None, []
        for c in list(p):
            if local(c) == "bridgehead":
                now = ET.Element(level)
                c.tag = "title"
                now.append(c)
                kept.append(now)
                log.append(("bridgehead", level))
            elif now is not None and local(c) not in SECTIONS:
                now.append(c)
            else:
                kept.append(c)
        p[:] = kept


def empty_media(root, log):
    n = prune(root, lambda e: local(e) in ("mediaobject", "imageobject", "inlinemediaobject") and len(e) == 0)
    log.extend([("empty media", "")] * n)
    for e in root.iter():
        if local(e) == "figure" and any(local(x) == "tgroup" for x in e):
            e.tag = "table"
            log.append(("table as figure", ""))


def content_models(root, log):
    """Children that an element may not hold go behind it; lists' bare content becomes an item."""
    up = links_up(root)
    for e in list(root.iter()):
        allowed = MAY_HOLD.get(local(e))
        for c in list(e) if allowed else []:
            if local(c) not in allowed:
                if local(e) in ("itemizedlist", "orderedlist"):
                    wrap(e, c, "listitem")
                elif e in up:
                    remove(e, c)
                    c.tail = None
                    up[e].insert(list(up[e]).index(e) + 1, c)
                log.append(("content", f"{local(e)}/{local(c)}"))


def section_order(root, log):
    """Blocks behind a subsection move before the first one."""
    for e in root.iter():
        kids = list(e)
        first = next((k for k, c in enumerate(kids) if local(c) in SECTIONS), None)
        late = [c for c in kids[first or 0 :] if local(c) not in SECTIONS] if first is not None else []
        if late:
            e[:] = kids[:first] + late + [c for c in kids[first:] if local(c) in SECTIONS]
            log.append(("order", local(e)))


def empty_elements(root, log):
    full = (*MEDIA, "xref", "anchor", "colspec", "entry", "title", "ulink", "link")
    n = prune(root, lambda e: local(e) not in full and len(e) == 0 and not (e.text or "").strip())
    log.extend([("empty", "")] * n)


def required_attributes(root, log):
    for e in root.iter():
        if local(e) == "tgroup" and not e.get("cols"):
            row = next((r for part in ("tbody", "thead") for b in e if local(b) == part for r in b if local(r) == "row"), ())
            e.set("cols", str(len(row) or 1))
            log.append(("cols", e.get("cols")))
        if local(e) == "imagedata" and not e.get("fileref"):
            e.set("fileref", "placeholder.png")
            log.append(("fileref", ""))


def section_ids(root, log):
    """Chapters and sections without an id get one by their place."""
    seen = {e.get("id") for e in root.iter() if e.get("id")}

    def go(e, prefix):
        n = 0
        for c in e:
            name = local(c)
            if name in (*SECTIONS, "chapter"):
                n += 1
                made = f"{prefix}{'s' if name in SECTIONS else 'ch'}{n:04d}"[:24]
                if not c.get("id") and made not in seen:
                    c.set("id", made)
                    seen.add(made)
                    log.append(("id", made))
                go(c, c.get("id") or made)
            else:
                go(c, prefix)

    if local(root) in (*SECTIONS, "chapter") and not root.get("id"):
        root.set("id", "ch0001")
        log.append(("id", "ch0001"))
    go(root, root.get("id") or "")


def excluded_elements(root, log):
    """Foreign elements are retagged, unwrapped or removed."""
    for e in root.iter():
        if local(e) in RETAGGED:
            log.append(("retag", local(e)))
            if local(e) in ("b", "strong"):
                e.set("role", "bold")
            e.tag = RETAGGED[local(e)]
    log.extend((how, local(c)) for how, c in rebuilt(root, lambda parent, child: EXCLUDED.get(local(child))))


def tidy_space(root, log):
    for e in root.iter():
        if local(e) in ("title", "para") and e.text and len(e) == 0 and e.text != (short := " ".join(e.text.split())):
            e.text = short
            log.append(("space", local(e)))
    n = prune(root, lambda e: local(e) == "figure" and not any(local(x) in MEDIA for x in e.iter() if x is not e))
    log.extend([("empty figure", "")] * n)


def dangling_links(root, log):
    """Links to ids that the chapter lacks give their text up."""
    ids = {e.get("id") for e in root.iter() if e.get("id")}
    gone = {"link": "unwrap", "xref": "remove"}
    done = rebuilt(root, lambda parent, child: gone[local(child)] if local(child) in gone and child.get("linkend") not in ids else None)
    log.extend(("link", c.get("linkend") or "") for _, c in done)


def nested_sections(root, log):
    """A section directly inside one of its own level goes one level down."""

    def go(e):
        for c in e:
            if local(c) in SECTIONS and local(c) == local(e) and local(c) != "sect5":
                c.tag = SECTIONS[SECTIONS.index(local(c)) + 1]
                log.append(("nested section", c.tag))
            go(c)

    go(root)


#: Name and rewrite, in order.
CHAIN: dict[str, Callable] = {
    "fix_13_excluded": excluded_elements, "fix_04_levels": section_levels, "fix_07_bridgeheads": bridgeheads, "fix_05_cals": cals_tables, "fix_02_formal": formalise, "fix_03_figures": figure_model,
    "fix_06_paragraphs": flat_paragraphs, "fix_08_media": empty_media, "fix_09_models": content_models, "fix_09_order": section_order, "fix_15_sections": nested_sections, "fix_10_empty": empty_elements,
    "fix_01_titles": add_titles, "fix_11_attributes": required_attributes, "fix_12_ids": section_ids, "fix_14_space": tidy_space, "fix_15_links": dangling_links,
}


def fixed(xml: str | None, names: list[str], rewrites: dict[str, Callable] | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The rewritten text and the log; what is no XML stays as it is with an entry that says so. ``rewrites``: CHAIN by default."""
    root = parse(xml)
    if root is None:
        return xml, [("parse", "malformed", "")]
    log: list[tuple[str, str, str]] = []
    for name in names:
        own: list[tuple[str, str]] = []
        (rewrites or CHAIN)[name](root, own)
        log += [(name, kind, detail) for kind, detail in own]
    return ET.tostring(root, encoding="unicode"), log


def _row_by_row(df: DataFrame, key: str, xml: str, out: list[tuple[str, pa.DataType, str]], work: Callable) -> DataFrame:
    """``work(text)`` for each row's XML as the columns ``out`` beside the key; equal texts of a batch are worked on once."""
    ship(df.sparkSession)
    narrow = df.select(F.col(key), F.col(xml).alias("__xml"))

    def run(batches):
        for b in batches:
            texts, place = b.column(1), None
            if pa.types.is_string(texts.type):
                distinct = texts.dictionary_encode(null_encoding="encode")
                texts, place = distinct.dictionary, distinct.indices
            rows = [work(x.as_py()) for x in texts]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(out)]
            columns = columns if place is None else [c.take(place) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *(n for n, _, _ in out)])

    return narrow.mapInArrow(run, ", ".join([f"`{key}` {narrow.schema[key].dataType.simpleString()}", *(f"`{n}` {t}" for n, _, t in out)]))


_LOG = pa.list_(pa.struct([("fix", pa.string()), ("kind", pa.string()), ("detail", pa.string())]))


def rewrite(df: DataFrame, key: str = "chapter", xml: str = "xml", fixes: list[str] | None = None, rewrites: dict[str, Callable] | None = None) -> DataFrame:
    """``(key, xml, fixes)``: every chapter through the chain, or through other ``rewrites``, with its log."""
    names = list(fixes or rewrites or CHAIN)

    def work(x):
        new, log = fixed(x, names, rewrites)
        return new, [{"fix": a, "kind": b, "detail": c} for a, b, c in log]

    return _row_by_row(df, key, xml, [("xml", pa.string(), "string"), ("fixes", _LOG, "array<struct<fix:string,kind:string,detail:string>>")], work)


def fix_counts(rewritten: DataFrame) -> DataFrame:
    return rewritten.select(F.explode("fixes").alias("f")).groupBy("f.fix", "f.kind").agg(F.count(F.lit(1)).alias("n"))


# ---- node table and checks ----
def nodes_of(xml: str | None) -> list[dict]:
    root = parse(xml)
    out: list[dict] = []

    def go(e, parent, path, place):
        own = f"{path}/{local(e)}[{place}]"
        me = len(out)
        out.append({"node_id": me, "parent_id": parent, "path": own, "tag": local(e), "attrs": list(e.attrib.items()), "text": (e.text or "").strip(), "tail": (e.tail or "").strip()})
        seen: dict[str, int] = {}
        for c in e:
            seen[local(c)] = seen.get(local(c), 0) + 1
            go(c, me, own, seen[local(c)])

    if root is not None:
        go(root, None, "", 1)
    return out


_NODE = pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("path", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("tail", pa.string())]))
_NODE_SQL = "array<struct<node_id:int,parent_id:int,path:string,tag:string,attrs:map<string,string>,text:string,tail:string>>"


def node_table(df: DataFrame, key: str = "chapter", xml: str = "xml") -> DataFrame:
    """One row for each element: ids in document order, path, tag, attributes and texts."""
    made = _row_by_row(df, key, xml, [("nodes", _NODE, _NODE_SQL)], lambda x: (nodes_of(x),))
    return made.select(key, F.inline("nodes"))


def element_counts(nodes: DataFrame, key: str = "chapter") -> DataFrame:
    is_section = F.col("tag").isin(*SECTIONS, "section")
    return nodes.groupBy(key).agg(*(F.count_if(F.col("tag") == t).alias(t) for t in ("chapter", "imagedata", "table", "equation")), F.count_if(is_section).alias("sections"))


def node_kind(tag: Column) -> Column:
    return F.when(tag.isin("chapter", "appendix", "preface"), "chapter").when(tag == "toc", "toc").when(tag.isin(*MEDIA), "media").when(tag.isin("emphasis", "literal", "superscript", "subscript", "link", "ulink", "xref"), "inline").otherwise("block")


def broken_links(nodes: DataFrame, key: str = "chapter") -> DataFrame:
    """Links whose target id is not in the same chapter; a page reference has a remark of its own."""
    ids = nodes.select(key, F.col("attrs")["id"].alias("target")).filter("target IS NOT NULL")
    used = nodes.filter(F.col("tag").isin("link", "xref")).select(key, "node_id", F.col("attrs")["linkend"].alias("target"))
    return used.join(ids, [key, "target"], "left_anti").withColumn("is_page", F.coalesce(F.col("target").startswith("page_"), F.lit(False)))


_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def dangling_targets(xml: Column) -> Column:
    """Targets of a chapter's links that none of its ids meets, null for a link without target.

    Read from the tags inside the chapter's own row, without a parser or a join; a
    chapter that is no XML is read as far as its tags go.
    """
    bare = F.regexp_replace(xml, r"(?s)<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>|<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    value = lambda tag, name: F.nullif(F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*(["'])(.*?)\1""", 2), F.lit(""))
    of = lambda names: F.regexp_extract_all(bare, F.lit(rf"(?s)<(?:[\w.-]+:)?{names}(?=[\s/>]){_ATTRIBUTES}>"), F.lit(0))
    ids = F.transform(F.regexp_extract_all(bare, F.lit(rf"""(?s)<[\w:.-]+(?=[^>]*\sid\s*=){_ATTRIBUTES}>"""), F.lit(0)), lambda t: value(t, "id"))
    targets = F.transform(of("(?:link|xref)"), lambda t: value(t, "linkend"))
    known = F.filter(ids, lambda i: i.isNotNull())
    return F.filter(targets, lambda t: t.isNull() | ~F.array_contains(known, t))


def errors_of(nodes: list[dict]) -> list[dict]:
    """Errors of one chapter's nodes by the rule subset: titles, required attributes, allowed children, dangling links."""
    out: list[dict] = []
    by_id = {n["node_id"]: n for n in nodes}
    attrs = {n["node_id"]: dict(n["attrs"] or ()) for n in nodes}
    titled = {n["parent_id"] for n in nodes if n["tag"] in ("title", "info")}
    ids = {a["id"] for a in attrs.values() if a.get("id") is not None}

    def error(node, kind, text):
        out.append({"path": node["path"], "error_type": kind, "error_description": text, "severity": "Error"})

    for n in nodes:
        tag, own, parent = n["tag"], attrs[n["node_id"]], by_id.get(n["parent_id"])
        if tag in TITLED and n["node_id"] not in titled:
            error(n, "Invalid Content Model", f"{tag} has no title")
        for need in REQUIRED.get(tag, ()):
            if own.get(need) is None:
                error(n, "Missing Attribute", f"{tag} lacks {need}")
        if parent is not None and tag not in MAY_HOLD.get(parent["tag"], (tag,)):
            error(parent, "Invalid Element", f"{parent['tag']} holds {tag}")
        if tag in ("link", "xref") and own.get("linkend") not in ids:
            error(n, "Broken Link", own.get("linkend") or "")
    return out


_ERRORS = pa.list_(pa.struct([(n, pa.string()) for n in ("path", "error_type", "error_description", "severity")]))
_ERRORS_SQL = "array<struct<path:string,error_type:string,error_description:string,severity:string>>"


def violations(nodes: DataFrame, key: str = "chapter") -> DataFrame:
    """Error rows of the rule subset, from a node table: each chapter's nodes meet in one row, nothing is joined. No full validation."""
    grouped = nodes.groupBy(key).agg(F.collect_list(F.struct("node_id", "parent_id", "path", "tag", "attrs")).alias("nodes"))
    return _row_by_row(grouped, key, "nodes", [("errors", _ERRORS, _ERRORS_SQL)], lambda x: (errors_of(x),)).select(key, F.inline("errors"))


def chapter_violations(df: DataFrame, key: str = "chapter", xml: str = "xml") -> DataFrame:
    """The same error rows from the chapters' texts, each found inside its chapter's row."""
    return _row_by_row(df, key, xml, [("errors", _ERRORS, _ERRORS_SQL)], lambda x: (errors_of(nodes_of(x)),)).select(key, F.inline("errors"))


def chapter_verdicts(df: DataFrame, key: str = "chapter", xml: str = "xml") -> DataFrame:
    """``(key, is_valid, n_errors, by_type)``: one row for each chapter, its errors counted inside its row."""

    def work(x):
        found = sorted(Counter(e["error_type"] for e in errors_of(nodes_of(x))).items())
        return sum(n for _, n in found), found or None

    made = _row_by_row(df, key, xml, [("n_errors", pa.int64(), "bigint"), ("by_type", pa.map_(pa.string(), pa.int64()), "map<string,bigint>")], work)
    return made.select(key, (F.col("n_errors") == 0).alias("is_valid"), "n_errors", "by_type")


# ---- conversions ----
class _Tables(HTMLParser):
    """Cells of all tables of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.stack: list[list[int]] = []
        self.table, self.now = -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
            self.stack.append([self.table, -1, -1])
        elif self.stack and tag == "tr":
            self.stack[-1][1] += 1
            self.stack[-1][2] = -1
        elif self.stack and tag in ("td", "th"):
            self.stack[-1][2] += 1
            span = dict(attrs)
            number = lambda k: int(span[k]) if (span.get(k) or "").isdigit() else 1
            self.now = {"table_id": self.stack[-1][0], "row": max(self.stack[-1][1], 0), "cell": self.stack[-1][2], "tag": tag, "colspan": number("colspan"), "rowspan": number("rowspan"), "text": ""}
            self.cells.append(self.now)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.now = None
        elif tag == "table" and self.stack:
            self.stack.pop()
            self.now = None

    def handle_data(self, data):
        if self.now is not None:
            self.now["text"] = " ".join((self.now["text"] + " " + data).split())


def table_cells_of(page: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return parser.cells


_CELL = pa.list_(pa.struct([("table_id", pa.int32()), ("row", pa.int32()), ("cell", pa.int32()), ("tag", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("text", pa.string())]))
_CELL_SQL = "array<struct<table_id:int,row:int,cell:int,tag:string,colspan:int,rowspan:int,text:string>>"


def html_tables(df: DataFrame, key: str, page: str) -> DataFrame:
    """One row for each cell of each table of each page."""
    return _row_by_row(df, key, page, [("cells", _CELL, _CELL_SQL)], lambda x: (table_cells_of(x),)).select(key, F.inline("cells"))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def table_markup(cells: list[dict], title: str = "Table") -> str:
    """A CALS table of one table's cells; the first row of header cells is its head."""
    rows: dict[int, list[dict]] = {}
    for c in cells:
        rows.setdefault(c["row"], []).append(c)
    if not rows:
        return ""
    columns = max(sum(c["colspan"] for c in r) for r in rows.values())
    head = [r for r in rows.values() if all(c["tag"] == "th" for c in r)]
    body = [r for r in rows.values() if r not in head]

    def lines(part):
        return "".join("<row>" + "".join(f"<entry>{_escaped(c['text'])}</entry>" for c in r) + "</row>" for r in part)

    return f'<table><title>{_escaped(title)}</title><tgroup cols="{columns}">' + (f"<thead>{lines(head)}</thead>" if head else "") + f"<tbody>{lines(body)}</tbody></tgroup></table>"


_INLINE = [(re.compile(r"\*\*(.+?)\*\*"), r'<emphasis role="bold">\1</emphasis>'), (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), r'<emphasis role="italics">\1</emphasis>'), (re.compile("`(.+?)`"), r"<literal>\1</literal>")]


def _inline(text: str) -> str:
    out = _escaped(text)
    for pattern, new in _INLINE:
        out = pattern.sub(new, out)
    return out


def markdown_markup(text: str | None) -> str:
    """A chapter of markdown: headings nest as sections, lists, code, pipe tables, images and paragraphs."""
    out, open_sections, items, rows, para, code = [], [], [], [], [], None
    kind = ""

    def flush():
        nonlocal kind
        if para:
            out.append(f"<para>{_inline(' '.join(para))}</para>")
            para.clear()
        if items:
            out.append(f"<{kind}>" + "".join(f"<listitem><para>{_inline(i)}</para></listitem>" for i in items) + f"</{kind}>")
            items.clear()
        if rows:
            out.append(table_markup([{"row": r, "colspan": 1, "tag": "th" if r == 0 else "td", "text": c} for r, cells in enumerate(rows) for c in cells]))
            rows.clear()

    for line in (text or "").split("\n"):
        bare = line.strip()
        if code is not None:
            if bare.startswith("```"):
                out.append(f"<programlisting>{_escaped(chr(10).join(code))}</programlisting>")
                code = None
            else:
                code.append(line)
        elif bare.startswith("```"):
            flush()
            code = []
        elif m := re.match(r"(#{1,6})\s+(.*)", bare):
            flush()
            level = min(len(m[1]), 6)
            while open_sections and open_sections[-1] >= level:
                open_sections.pop()
                out.append(f"</sect{len(open_sections) + 1}>")
            if len(open_sections) < 5:
                open_sections.append(level)
                out.append(f"<sect{len(open_sections)}><title>{_inline(m[2])}</title>")
            else:
                out.append(f"<bridgehead>{_inline(m[2])}</bridgehead>")
        elif m := re.match(r"!\[([^\]]*)\]\(([^)]*)\)", bare):
            flush()
            out.append(f'<figure><title>{_inline(m[1] or "Figure")}</title><mediaobject><imageobject><imagedata fileref="{_escaped(m[2])}"/></imageobject></mediaobject></figure>')
        elif m := re.match(r"(?:([-*+•])|[0-9]+[.)])\s+(.*)", bare):
            wanted = "itemizedlist" if m[1] else "orderedlist"
            if not items or kind != wanted:
                flush()
            kind = wanted
            items.append(m[2])
        elif bare.startswith("|"):
            if not rows:
                flush()
            if not re.fullmatch(r"\|?[\s:|-]+\|?", bare):
                rows.append([c.strip() for c in bare.strip("|").split("|")])
        elif not bare:
            flush()
        else:
            if items or rows:
                flush()
            para.append(bare)
    if code is not None:
        out.append(f"<programlisting>{_escaped(chr(10).join(code))}</programlisting>")
    flush()
    for k in range(len(open_sections), 0, -1):
        out.append(f"</sect{k}>")
    return "<chapter>" + "".join(out) + "</chapter>"


def from_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    return _row_by_row(df, key, text, [("xml", pa.string(), "string")], lambda x: (markdown_markup(x),))


def from_blocks(labelled: DataFrame, key: str, order: str, label: str = "label", text: str = "text") -> DataFrame:
    """Labelled blocks of each document as one chapter, in order."""
    safe = F.replace(F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    of = lambda *tags: F.concat(*(F.lit(f"<{t}>") for t in tags), safe, *(F.lit(f"</{t}>") for t in reversed(tags)))
    block = F.when(F.col(label).isin("chapter", "part", "book_title", "section", "toc"), of("bridgehead")).when(F.col(label) == "list_item", of("itemizedlist", "listitem", "para")).when(F.col(label) == "", F.lit("")).otherwise(of("para"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return labelled.groupBy(key).agg(F.concat(F.lit("<chapter>"), F.array_join(F.transform(parts, lambda p: p["b"]), ""), F.lit("</chapter>")).alias("xml"))


def chapters_of(xml: str | None) -> list[dict]:
    """Chapters of a book: entity, file name, kind and title, each with its own text."""
    root = parse(xml)
    out = []
    for e in root.iter() if root is not None else ():
        if local(e) in ("chapter", "appendix", "preface", "glossary", "index", "bibliography"):
            title = next((text_of(c) for c in e if local(c) == "title"), "")
            n = len(out) + 1
            out.append({"entity": f"ch{n:04d}", "filename": f"ch{n:04d}.xml", "kind": local(e), "title": title, "xml": ET.tostring(e, encoding="unicode")})
    return out


_CHAPTER = pa.list_(pa.struct([(n, pa.string()) for n in ("entity", "filename", "kind", "title", "xml")]))


def split_chapters(df: DataFrame, key: str = "book", xml: str = "xml") -> DataFrame:
    made = _row_by_row(df, key, xml, [("chapters", _CHAPTER, "array<struct<entity:string,filename:string,kind:string,title:string,xml:string>>")], lambda x: (chapters_of(x),))
    return made.select(key, F.posexplode("chapters").alias("n", "c")).select(key, "n", "c.entity", "c.filename", "c.kind", "c.title", "c.xml")


def toc(chapters: DataFrame, key: str = "book") -> DataFrame:
    """A table of contents for each book."""
    entry = F.concat(F.lit('<tocentry linkend="'), F.col("entity"), F.lit('">'), F.col("title"), F.lit("</tocentry>"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("n"), entry.alias("e"))))
    return chapters.groupBy(key).agg(F.concat(F.lit("<toc><title>Table of Contents</title>"), F.array_join(F.transform(parts, lambda p: p["e"]), ""), F.lit("</toc>")).alias("toc"))


def doctype(xml: Column, root: str, system: str) -> Column:
    """A text with exactly this DOCTYPE."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>\s*", ""), r"^\s*<\?xml[^>]*\?>\s*", "")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE {root} SYSTEM "{system}">\n'), bare)


def book_info(xml: Column) -> Column:
    """Title, ISBN and authors of a book without DOCTYPE; the text must be well formed."""
    return F.struct(F.xpath_string(xml, F.lit("//bookinfo/title")).alias("title"), F.xpath_string(xml, F.lit("//bookinfo/isbn")).alias("isbn"), F.xpath(xml, F.lit("//bookinfo/author/text()")).alias("authors"))


def image_facts(data: bytes | None) -> tuple[int, int, str]:
    """Width, height and format of PNG, GIF and JPEG by their magic bytes."""
    b = data or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return int.from_bytes(b[16:20]), int.from_bytes(b[20:24]), "PNG"
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little"), "GIF"
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 <= len(b) and b[at] == 0xFF:
        mark, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9]), int.from_bytes(b[at + 5 : at + 7]), "JPEG"
        at += 2 if mark in (0xD8, 0xD9) else 2 + size
    return 0, 0, ""


def images(df: DataFrame, key: str, content: str) -> DataFrame:
    """Width, height and format of each image."""
    return _row_by_row(df, key, content, [("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("format", pa.string(), "string")], image_facts)
