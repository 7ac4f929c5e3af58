"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, in one pass whose cost is linear
in the page. First pass: each block is decided good or bad, or left open, by
stop-word density, length and link density, within what the page's structure rules
out (elements, roles and class names of menus, notices, comments and the like).
A name rules nothing out that holds nearly all of the page's plain text. Second pass:
open blocks (short ones, and long ones with few stop words) take the label of the
nearest decided neighbour, looking inside their own container first; headings look
at what follows them.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Characters from which a block is long, and stop-word shares that decide.
SHORT, HIGH, LOW, LINKS = 70, 0.2, 0.1, 0.5
HELD = 1 << 24
#: Share of a page's plain text that no class name can rule out.
MOST_TEXT = 0.8
#: Named containers around a block that are looked at, the innermost ones.
MOST_NAMES = 64

# Element names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript template svg math iframe xmp noembed noframes".split())
OUT_TAGS = frozenset("head nav footer aside form button select option dialog menu label input noscript".split())
INLINE_TAGS = frozenset("b i em strong span a u".split())
GROUP_TAGS = frozenset("article main section div body td aside nav footer header form".split())
#: Elements that end the search for an open block of the same kind.
HOLDERS = frozenset("table ul ol dl div article section".split())
#: Closed by the next block of their kind.
ONE_AT_A_TIME = frozenset("p li dt dd tr td th option".split())
# Parts of class names and ids, which are split at hyphens, underscores and changes of case.
#: A name that begins or ends with one of these is that of something beside the article.
OUT_PARTS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices alert alerts
popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget widgets footer masthead share sharing social related recommended recommendations
newsletter subscribe subscription signup login search searchbox pagination pager toc tags copyright disclaimer skip hidden header
""".split())  # fmt: skip
#: Readers' comments, which may be longer than the article.
COMMENT_PARTS = frozenset("comment comments commentlist disqus respond replies reply reviews".split())
#: A name with one of these says something else about its element.
NOT_PARTS = frozenset("has no not with without is overflow under below above toggle toggled collapsed open enabled disabled".split())
#: Containers of the text itself; their headers hold its headline.
TEXT_PARTS = frozenset("post entry article content story text main body single hentry blog".split())
_PARTS = re.compile(r"[-_:./]+|(?<=[a-z])(?=[A-Z])")
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
STOP_WORDS = frozenset("""
a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on or our she so than that the their them there they this to was we were what when which who will with would you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
aber als am auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so um und uns vom von vor war was wenn wie wir wird zu zum zur über für
al como con cuando del desde donde el ella ellos era es esta este fue ha hay la las lo los me mi muy más no nos o para pero por porque que se ser si sin sobre son su sus también te un una uno y ya
""".split())  # fmt: skip

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: One attribute with its value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SENTENCE = re.compile(r"[.!?。！？…](?:\s|$)")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("parts", "linked", "out", "names", "inside", "group", "heading", "text")

    def __init__(self, out: bool, names: tuple[int, ...], inside: bool, group: int, heading: bool):
        self.parts, self.linked, self.out, self.names, self.inside, self.group, self.heading = [], 0, out, names, inside, group, heading


def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether a class list or id names something beside the article, readers' comments, or a container of text."""
    beside = comments = content = False
    for token in value.split():
        parts = [x.lower() for x in _PARTS.split(token) if x]
        if not parts:
            continue
        ends = {parts[0], parts[-1], parts[0].rstrip("0123456789"), parts[-1].rstrip("0123456789")}
        textual = not TEXT_PARTS.isdisjoint(parts)
        content = content or textual
        if NOT_PARTS.isdisjoint(parts) and not (textual and parts[-1] == "header"):
            comments = comments or not COMMENT_PARTS.isdisjoint(ends)
            beside = beside or not OUT_PARTS.isdisjoint(ends)
    return beside or comments, comments, content


class _Container:
    """Where the parser stands: what rules a block out, and what it lies in."""

    __slots__ = ("tag", "out", "names", "inside", "textual", "group")

    def __init__(self, tag: str, out: bool, names: tuple[int, ...], inside: bool, textual: bool, group: int):
        self.tag, self.out, self.names, self.inside, self.textual, self.group = tag, out, names, inside, textual, group


def blocks(page: str) -> list[_Block]:
    """The non-empty blocks of a page in order, with ``out`` settled."""
    out: list[_Block] = []
    stack = [_Container("", False, (), False, False, 0)]
    at_of: dict[str, list[int]] = {}  # where each tag stands in the stack, so that none is ever searched for
    last_block = [0]
    comments: set[int] = set()
    links = groups = names_seen = 0
    now = _Block(False, (), False, 0, False)

    def cut(heading: bool = False) -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        top = stack[-1]
        now = _Block(top.out, top.names, top.inside, top.group, heading)

    def text(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if links:
                now.linked += len(raw)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            at_of[gone.tag].pop()
            if last_block[-1] == len(stack) and len(stack):
                last_block.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            open_at = at_of.get(tag)
            if tag == "a":
                links = max(0, links - 1)
            if open_at and not (tag in INLINE_TAGS and last_block[-1] > open_at[-1]):
                leave(open_at[-1])
            if tag in BLOCK_TAGS:
                links = 0
                cut()
            continue
        attributes = m.group(3)
        if tag in RAW_TAGS and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            cut()
            at = close.end() if close else end
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            if tag in BLOCK_TAGS:
                cut(now.heading)
            continue
        if tag in ONE_AT_A_TIME and at_of.get(tag):
            same = at_of[tag][-1]
            if all(not at_of.get(t) or at_of[t][-1] < same for t in HOLDERS):
                leave(same)
        if tag == "a":
            links += 1
        top = stack[-1]
        bad, names, textual = top.out or tag in OUT_TAGS or tag == "header" and not (top.inside or top.textual), top.names, top.textual
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"' ")
                if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                    beside, by_readers, content = _named(value)
                    textual = textual or content
                    if beside and not bad:
                        names_seen += 1
                        names = (*names[-MOST_NAMES:], names_seen)
                        if by_readers:
                            comments.add(names_seen)
                elif name == "role" and value.lower() in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    bad = True
        inside = top.inside or tag in ("article", "main")
        is_block = tag in BLOCK_TAGS
        group = top.group
        if is_block and tag in GROUP_TAGS:
            groups += 1
            group = groups
        changed = bad != top.out or names != top.names
        at_of.setdefault(tag, []).append(len(stack))
        if is_block:
            last_block.append(len(stack))
        stack.append(_Container(tag, bad, names, inside, textual, group))
        if is_block:
            links = 0
            cut(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
        elif changed:
            cut(now.heading)
    if now.parts:
        out.append(now)
    kept = []
    for b in out:
        b.text = _SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
        if b.text:
            kept.append(b)
    _settle_names(kept, comments)
    return kept


def _settle_names(found: list[_Block], comments: set[int]) -> None:
    """A name rules its container out unless that holds nearly all of the page's plain text, in several long blocks; with comments, all of it."""
    weight: dict[int, int] = {}
    long: dict[int, int] = {}
    total = 0
    for b in found:
        if not b.out and not _linked(b):
            total += len(b.text)
            for name in b.names:
                weight[name] = weight.get(name, 0) + len(b.text)
                long[name] = long.get(name, 0) + (len(b.text) >= SHORT or b.heading)
    void = {k for k, w in weight.items() if long[k] >= 2 and (w == total if k in comments else w >= MOST_TEXT * total)}
    for b in found:
        b.out = b.out or any(name not in void for name in b.names)


def _stop_words(text: str) -> tuple[int, int]:
    """How many words, and how many of them are stop words."""
    found = [w.lower() for w in _WORD.findall(text)]
    return len(found), sum(w in STOP_WORDS for w in found)


def _linked(b: _Block) -> bool:
    return b.linked > LINKS * sum(map(len, b.parts))


def _first_pass(b: _Block, article: bool, listed: bool) -> bool | None:
    if b.out or _linked(b) or article and not b.inside:
        return False
    if len(b.text) < SHORT or b.heading:
        return None
    if not listed:
        return True
    n, stops = _stop_words(b.text)
    if stops >= HIGH * n:
        return True
    # hardly a stop word and no sentence: a list of names or key words
    return False if stops < LOW * n and not b.inside and not _SENTENCE.search(b.text) else None


def _labels(found: list[_Block], first: list[bool | None]) -> list[bool]:
    """Second pass: open blocks take the label of a decided neighbour."""
    n = len(found)
    before, after, label = [-1] * n, [n] * n, list(first)
    own_before, own_after = [-1] * n, [n] * n  # in the same container
    seen: dict[int, int] = {}
    last = -1
    for i, b in enumerate(found):
        before[i], own_before[i] = last, seen.get(b.group, -1)
        if first[i] is not None:
            last = seen[b.group] = i
    seen, last = {}, n
    for i in range(n - 1, -1, -1):
        after[i], own_after[i] = last, seen.get(found[i].group, n)
        if first[i] is not None:
            last = seen[found[i].group] = i
    for i, b in enumerate(found):
        if first[i] is not None:
            continue
        own = [j for j in (own_before[i], own_after[i]) if 0 <= j < n]
        near = own or [j for j in (before[i], after[i]) if 0 <= j < n]
        if b.inside and not any(first[j] for j in near):
            label[i] = True  # inside the article with no good neighbour to ask: the container decides
        elif b.heading and near and near[-1] > i:
            label[i] = first[near[-1]]
        else:
            # the nearest; of two as near, the good one
            label[i] = first[min(near, key=lambda j: (abs(j - i), not first[j]))] if near else False
    return label


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space; empty if there is none."""
    found = blocks(page or "")
    # long blocks say whether the page's language is one of the stop words'; if not, length and links decide
    long = [b for b in found if not b.out and not b.heading and len(b.text) >= SHORT and not _linked(b)]
    counts = [_stop_words(b.text) for b in long]
    listed = sum(s for _, s in counts) >= LOW * sum(n for n, _ in counts)
    dense = [0, 0]
    for b, (n, stops) in zip(long, counts, strict=True):
        if not listed or stops >= HIGH * n:
            dense[b.inside] += len(b.text)
    # a page that marks its article says where the text is, unless most of its dense text is elsewhere, as beside teasers
    article = any(b.inside and not b.out for b in found) and dense[1] >= dense[0]
    first = [_first_pass(b, article, listed) for b in found]
    for least in (SHORT, 1):  # nothing dense: long plain blocks are the best there is, then sentences of any length
        if True not in first:
            first = [True if f is None and not b.heading and len(b.text) >= least and _SENTENCE.search(b.text) else f for b, f in zip(found, first, strict=True)]
    return " ".join(b.text for b, good in zip(found, _labels(found, first), strict=True) if good)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)`` for every row: the main text of the whole page.

    A null or empty page has an empty text; repeated rows are read each; null ids
    and addresses stay; other columns are not read; an empty table gives an empty
    result. Unclosed and cut-off tags are read to the end of the page.
    """
    ship(df.sparkSession)
    narrow = df.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))

    def run(batches):
        for batch in batches:
            at, held, texts = 0, 0, []
            for i, page in enumerate(batch.column(2)):
                texts.append(main_text(page.as_py()))
                held += len(texts[-1])
                if held > HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])
                    at, held, texts = i + 1, 0, []

    kind = {c: narrow.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return narrow.mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string")
