"""Two further rule sets for chapters: the core one, which reports by category, and the one aimed at figures, tables and sections.

Both are chains of rewrites on a parsed tree like those of ``markup`` and run
through ``markup.rewrite``.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from .markup import CHAIN, SECTIONS, local, rebuilt, text_of

# ---- fixed values: element names, placeholders and default texts of the rule sets ----------------
CORE_TITLED = ("chapter", *SECTIONS, "figure", "table", "example", "appendix")
CHAPTER_MAY_HOLD = frozenset("beginpage chapterinfo title subtitle titleabbrev tocchap toc lot index glossary bibliography sect1 section".split())
CHAPTER_HEAD = frozenset("beginpage chapterinfo title subtitle titleabbrev tocchap".split())
BLOCKS = frozenset("para itemizedlist orderedlist variablelist figure informalfigure table informaltable example blockquote mediaobject programlisting note tip warning caution important".split()) | frozenset(SECTIONS)
REAL_MEDIA = ("imagedata", "videodata", "audiodata")
MEDIA_HOLDERS = ("imageobject", "videoobject", "audioobject")
PLACEHOLDERS, BLANKS = ("not available", "no image"), ("", "n/a")
NO_TITLES = ("", "untitled", "no title", "n/a")
FOREIGN = frozenset("html body div span br hr style script".split())
LONGEST_ID = 24
# --------------------------------------------------------------------------------------------------


def _has(e: ET.Element, *names: str) -> bool:
    return any(local(x) in names for x in e.iter() if x is not e)


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if local(c) == name), None)


def _placeholder(e: ET.Element, blanks: bool) -> bool:
    texts = [(x.text or "").strip().lower() for x in e.iter() if local(x) == "phrase" and x.text is not None]
    return any(t in BLANKS and blanks or any(p in t for p in PLACEHOLDERS) for t in texts)


def _titled(e: ET.Element, text: str | None) -> None:
    title = ET.Element("title")
    title.text = text
    e.insert(0, title)


def _bold(text: str | None) -> ET.Element:
    out = ET.Element("emphasis", role="bold")
    out.text = text
    return out


# ---- core rules ----
def core_media(root, log):
    """Media objects without media go, and so does what held nothing else."""
    emptied = set()

    def judge(parent, child):
        if local(child) == "mediaobject" and (_placeholder(child, True) or not _has(child, *REAL_MEDIA)):
            emptied.add(parent)
            log.append(("Empty Mediaobject", local(parent)))
            return "remove"
        if child in emptied and not len(child) and not (child.text or "").strip():
            log.append(("Empty Element", local(child)))
            return "remove"
        return None

    rebuilt(root, judge)


def core_figures(root, log):
    """Figures without media go; one that is called a table stays as a paragraph of its title."""

    def judge(parent, child):
        if local(child) != "figure" or _has(child, *REAL_MEDIA) and not _placeholder(child, False):
            return None
        title = _child(child, "title")
        name = text_of(title) if title is not None else ""
        log.append(("Misclassified Figure", name[:40]))
        if name.lower() in NO_TITLES or "table" not in name.lower():
            return "remove"
        child.tag, child.text, child[:] = "para", title.text, list(title)
        return None

    rebuilt(root, judge)


def core_rows(root, log):
    gone = rebuilt(root, lambda parent, child: "remove" if local(child) == "row" and not _has(child, "entry") else None)
    log.extend([("Empty Element", "row")] * len(gone))


def core_paragraphs(root, log):
    """A paragraph in a paragraph gives its content up; one with blocks follows the outer paragraph instead."""
    nested = lambda parent, child: local(parent) == local(child) == "para"
    inline = lambda e: not any(local(x) in BLOCKS for x in e.iter() if x is not e)
    done = rebuilt(root, lambda parent, child: "unwrap" if nested(parent, child) and inline(child) else None)
    log.extend([("Nested Para", "unwrapped")] * len(done))
    for e in reversed(list(root.iter())):
        if local(e) == "para" or not any(nested(c, x) for c in e for x in c):
            continue
        kept = []
        for c in e:
            kept.append(c)
            out = [x for x in c if nested(c, x)]
            for x in out:
                c.remove(x)
                log.append(("Nested Para", "flattened"))
                tail, x.tail = (x.tail or "").strip(), None
                kept.append(x)
                if tail:
                    kept.append(ET.Element("para"))
                    kept[-1].text = tail
        e[:] = kept


def core_titles(root, log):
    for e in root.iter():
        if local(e) in CORE_TITLED and _child(e, "title") is None:
            _titled(e, None)
            log.append(("Missing Title", local(e)))


def core_models(root, log):
    """What a chapter may not hold behind its title goes into an introductory section."""
    for e in root.iter():
        kids = list(e) if local(e) == "chapter" else []
        first = next((k for k, c in enumerate(kids) if local(c) == "title"), len(kids))
        wrong = [c for c in kids[first + 1 :] if local(c) not in CHAPTER_MAY_HOLD]
        if wrong:
            section = ET.Element("sect1", id=f"{e.get('id') or 'chapter'}-intro"[:LONGEST_ID].rstrip("-"))
            _titled(section, None)
            section.extend(wrong)
            left = [c for c in kids if c not in set(wrong)]
            at = max((k + 1 for k, c in enumerate(left) if local(c) in CHAPTER_HEAD), default=0)
            e[:] = [*left[:at], section, *left[at:]]
            log.append(("Invalid Content Model", str(len(wrong))))


def core_attributes(root, log):
    for e in root.iter():
        if local(e) == "tgroup" and not e.get("cols"):
            rows = [next((r for r in part.iter() if local(r) == "row"), None) for name in ("tbody", "thead") for part in e.iter() if local(part) == name]
            widths = [sum(local(x) == "entry" for x in r.iter()) for r in rows if r is not None]
            e.set("cols", str(next((w for w in widths if w), 1)))
            log.append(("Missing Attribute", e.get("cols")))


def core_foreign(root, log):
    done = rebuilt(root, lambda parent, child: "unwrap" if local(child) in FOREIGN else None)
    log.extend(("Invalid Element", local(c)) for _, c in done)
    for e in root.iter():
        if local(e) == "p":
            e.tag = "para"
            log.append(("Invalid Element", "p"))


# ---- targeted rules ----
def target_images(root, log):
    """Image data of a figure without media stand in media objects behind the title; a figure of text alone becomes a paragraph."""
    for e in list(root.iter()):
        if local(e) != "figure" or _child(e, "graphic") is not None or _child(e, "mediaobject") is not None:
            continue
        found = [x for x in e.iter() if local(x) == "imagedata"]
        if found:
            rebuilt(e, lambda parent, child: "remove" if local(child) == "imagedata" else None)
            at = next((k + 1 for k, c in enumerate(e) if local(c) == "title"), 0)
            for x in reversed(found):
                x.tail = None
                x.set("width", "100%")
                x.set("scalefit", "1")
                box = ET.Element("mediaobject")
                ET.SubElement(box, "imageobject").append(x)
                e.insert(at, box)
                log.append(("wrapped image", ""))
        elif _child(e, "textobject") is not None:
            title, phrases = _child(e, "title"), [_child(x, "phrase") for x in e if local(x) == "textobject"]
            text = " ".join(p.text for p in phrases if p is not None and p.text)
            e.tag, e.text, e[:] = "para", None, []
            if title is not None and title.text:
                e.append(_bold(title.text))
                e[0].tail = ": " + text
            else:
                e.text = text
            log.append(("text figure", ""))


def target_media(root, log):
    done = rebuilt(root, lambda parent, child: "remove" if local(child) == "mediaobject" and local(parent) != "figure" and not any(local(x) in MEDIA_HOLDERS for x in child) else None)
    log.extend([("empty media", "")] * len(done))


def target_texts(root, log):
    """Text objects hold a phrase."""
    for e in root.iter():
        if local(e) == "textobject":
            bare = (e.text or "").strip()
            if bare or not len(e):
                phrase = ET.Element("phrase")
                phrase.text, e.text = e.text if bare else "Content not available", None
                e.insert(0, phrase)
                log.append(("phrase", "wrapped" if bare else "added"))


def target_image_objects(root, log):
    for e in root.iter():
        if local(e) == "imageobject" and _child(e, "imagedata") is None:
            ET.SubElement(e, "imagedata", fileref="placeholder.png", width="100%", scalefit="1")
            log.append(("image", "added"))


def target_order(root, log):
    """Figures hold a title, then media; anything else follows them."""
    for p in list(root.iter()):
        kept = []
        for e in p:
            kept.append(e)
            if local(e) != "figure":
                continue
            parts = {n: [c for c in e if local(c) == n] for n in ("title", "titleabbrev", "mediaobject", "graphic")}
            others = [c for c in e if local(c) not in (*parts, "blockinfo")]
            if others or parts["title"] and e[0] is not parts["title"][0]:
                e[:] = [*parts["title"][:1], *parts["titleabbrev"][:1], *parts["mediaobject"], *parts["graphic"]]
                kept += others
                log.append(("order", "figure"))
        p[:] = kept


def target_figure_titles(root, log):
    for e in root.iter():
        if local(e) == "figure":
            title = _child(e, "title")
            if title is None:
                _titled(e, "Figure")
                log.append(("figure title", "added"))
            elif not (title.text or "").strip():
                title.text = "Figure"
                log.append(("figure title", "filled"))


def target_figures(root, log):
    """A figure that still has no media becomes a paragraph of its title, or goes."""

    def judge(parent, child):
        if local(child) != "figure" or _child(child, "mediaobject") is not None or _child(child, "graphic") is not None:
            return None
        title = _child(child, "title")
        log.append(("removed figure", ""))
        if title is None or not title.text:
            return "remove"
        child.tag, child.text, child[:] = "para", None, [_bold(title.text)]
        return None

    rebuilt(root, judge)


def target_tables(root, log):
    for e in root.iter():
        if local(e) == "table":
            if _child(e, "title") is None:
                _titled(e, "Table")
                log.append(("table title", ""))
            for group in e:
                row = next((r for r in group.iter() if local(r) == "row"), None)
                if local(group) == "tgroup" and "cols" not in group.attrib and row is not None:
                    group.set("cols", str(sum(local(x) == "entry" for x in row)))
                    log.append(("cols", group.get("cols")))


def target_sections(root, log):
    for e in root.iter():
        if local(e) in SECTIONS:
            title = _child(e, "title")
            if title is None:
                _titled(e, "Section")
                log.append(("section title", ""))
            elif e[0] is not title:
                e.remove(title)
                e.insert(0, title)
                log.append(("title first", local(e)))


CORE = {"core_media": core_media, "core_figures": core_figures, "core_rows": core_rows, "core_paragraphs": core_paragraphs, "core_titles": core_titles, "core_models": core_models, "core_attributes": core_attributes, "core_foreign": core_foreign}
TARGETED = {
    "target_images": target_images, "target_media": target_media, "target_texts": target_texts, "target_image_objects": target_image_objects, "target_order": target_order,
    "target_figure_titles": target_figure_titles, "target_figures": target_figures, "target_tables": target_tables, "target_sections": target_sections,
}
#: Every rewrite by name, for ``markup.fixed``.
REWRITES = {**CHAIN, **CORE, **TARGETED}
