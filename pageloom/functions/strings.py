"""String functions over columns. Nulls give null unless a docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
# HTML presentation entities and their characters; the five XML entities are not among them.
ENTITIES = {
    "emsp": " ", "ensp": " ", "nbsp": " ", "thinsp": " ", "mdash": "—", "ndash": "–", "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"', "hellip": "…", "bull": "•", "middot": "·",
    "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "frac14": "¼", "frac34": "¾", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "pi": "π", "sigma": "σ", "omega": "ω", "Sigma": "Σ", "Omega": "Ω", "infin": "∞", "sum": "Σ", "prod": "∏", "radic": "√",
    "ne": "≠", "le": "≤", "ge": "≥", "asymp": "≈", "equiv": "≡", "rarr": "→", "larr": "←", "uarr": "↑", "darr": "↓", "harr": "↔",
}
BLANK_CODES = (160, 8194, 8195, 8201)
STRUCTURAL_CODES = (34, 38, 39, 60, 62)
FIGURE_WORDS = r"figure|fig\.|fig|image|img\.|plate|diagram|illustration|photo|photograph|exhibit|chart|graph|map|drawing|sketch"
TABLE_WORDS = r"table|tbl\.|tbl|tableau|tabelle|schedule|appendix\s+[a-z]?|exhibit|list|matrix"
CAPTION_TAIL = r"\s*\d+(?:[.\-]\d+)?[a-z]?\s*(?:[.:\-;)\]]|\s+\w)"
HYPHEN_STAYS = ("self", "non", "anti", "co", "semi", "quasi", "pseudo", "neo", "proto")
FIELD_NAMES = {
    "isbn": "isbn isbn13 isbn-13 isbn10 isbn-10", "title": "title book_title booktitle", "subtitle": "subtitle sub_title book_subtitle", "authors": "author authors author_name by",
    "publisher": "publisher publishername publisher_name", "pubdate": "pubdate publication_date date published year publicationdate", "edition": "edition edition_number",
    "copyright_year": "copyright_year copyrightyear copyright copyright_date", "copyright_holder": "copyright_holder copyrightholder holder rights_holder",
}
FILE_TYPES = {"pdf": "source", "xml": "output", "docx": "output", "zip": "package", "xlsx": "report", "json": "metadata", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "svg": "image", "tif": "image", "tiff": "image"}
ERROR_MARKS = (
    ("no declaration|not declared", "Undeclared Element"), ("does not follow|content model", "Invalid Content Model"), ("not allowed|unexpected", "Invalid Element"),
    ("required attribute|missing", "Missing Attribute"), ("invalid attribute", "Invalid Attribute"), ("id.*already defined|already defined.*id", "Duplicate ID"), ("entity", "Entity Error"),
    ("empty", "Empty Element Error"),
)
BULLETS = "•●○■□▪▫·*–—→⇒▸►-"
PART_NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
FRONT_MATTER = (
    "index", "table of contents", "contents in brief", "detailed contents", "contributors", "reviewers", "acknowledgments", "acknowledgements", "preface", "foreword", "introduction",
    "about the author", "about this book", "how to use", "key to", "nursing diagnoses", "essential terminology", "contents on", "davis plus",
)
# -------------------------------------------------------------------------------------------------


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strip_invalid_xml(text: Column) -> Column:
    """Without the characters that XML 1.0 does not allow; null gives an empty text."""
    return F.coalesce(F.regexp_replace(text, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", ""), F.lit(""))


def decode_entities(text: Column) -> Column:
    """Presentation entities and numeric references as characters; the five structural ones stay.

    Named entities are looked up piece by piece, so one pass serves them all.
    """
    names = _map(ENTITIES)

    def piece(p: Column) -> Column:
        # every piece but the first began with "&"
        name = F.regexp_extract(p, r"\A([A-Za-z]+[0-9]*);", 1)
        number = F.regexp_extract(p, r"\A#([0-9]{1,7});", 1)
        code = F.try_to_number(F.when(number != "", number), F.lit("9999999")).cast("int")
        tail = F.substring(p, F.instr(p, ";") + 1, F.length(p))
        wide = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & ~code.isin(*STRUCTURAL_CODES)
        # code points by their UTF-16 units, as big-endian bytes
        unit = lambda c: F.lpad(F.hex(c), 4, "0")
        high = unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10))
        low = unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF)))
        char = F.decode(F.unhex(F.when(code > 0xFFFF, F.concat(high, low)).otherwise(unit(code))), "UTF-16BE")
        return (
            F.when(F.element_at(names, name).isNotNull(), F.concat(F.element_at(names, name), tail)).when(code.isin(*BLANK_CODES), F.concat(F.lit(" "), tail))
            .when(wide, F.concat(char, tail)).otherwise(F.concat(F.lit("&"), p))
        )

    pieces = F.split(text, "&", -1)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")).otherwise(text)


def escape_content(text: Column) -> Column:
    return _swap(strip_invalid_xml(text), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_attribute(text: Column) -> Column:
    return _swap(escape_content(text), ('"', "&quot;"), ("'", "&apos;"))


def escape_all(text: Column) -> Column:
    """Decoded first, then all five escaped."""
    return escape_attribute(decode_entities(strip_invalid_xml(text)))


def escape_ampersands(text: Column) -> Column:
    """Decoded first; only ampersands that begin no structural entity are escaped."""
    return F.regexp_replace(decode_entities(strip_invalid_xml(text)), "&(?!(?:amp|lt|gt|quot|apos);)", "&amp;")


def _unescape_marks(text: Column) -> Column:
    return _swap(text, ("\\*", "*"), ("\\_", "_"), ("\\`", "`"))


def plain_title(text: Column) -> Column:
    """A title without markdown emphasis."""
    out = _unescape_marks(text)
    for pattern in (r"\*\*(.+?)\*\*", "__(.+?)__", r"(?<![*_])\*([^*]+?)\*(?![*_])", "(?<![*_])_([^_]+?)_(?![*_])"):
        out = F.regexp_replace(out, pattern, "$1")
    return F.coalesce(out, F.lit(""))


def inline_markup(text: Column) -> Column:
    """Markdown emphasis, code, super- and subscripts as tags; all other text escaped.

    Tags are written with private-use marks first, so that escaping at the end
    cannot touch them; runs of underscores are protected the same way.
    """
    bold, italic, code, above, below, shut, line = (chr(0xE000 + i) for i in range(7))
    out = F.regexp_replace(_unescape_marks(decode_entities(text)), "(?<=_)_|_(?=_)", line)
    rules = [
        (r"\*\*(.+?)\*\*", bold), (r"(?<![<>/])\*([^*<>]+?)\*(?![<>/])", italic), ("(?<![<>/])_([^_<>]+?)_(?![<>/])", italic), ("`(.+?)`", code),
        ("<sup>(.+?)</sup>", above), ("<superscript>(.+?)</superscript>", above), ("<sub>(.+?)</sub>", below), ("<subscript>(.+?)</subscript>", below),
    ]
    tags = {bold: ('emphasis role="bold"', "emphasis"), italic: ('emphasis role="italics"', "emphasis"), code: ("literal",) * 2, above: ("superscript",) * 2, below: ("subscript",) * 2}
    for pattern, mark in rules:
        out = F.regexp_replace(out, pattern, f"{mark}$1{shut}{mark}")
    out = escape_content(out)
    for mark, (opening, closing) in tags.items():
        out = _swap(out, (shut + mark, f"</{closing}>"), (mark, f"<{opening}>"))
    return _swap(out, (line, "_"))


def strip_font_note(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*<!--\s*font:\s*\d+\s*-->\s*", ""))


def joins_hyphen(current: Column, following: Column) -> Column:
    """Whether a hyphen at the end of ``current`` is a line break inside a word that ``following`` goes on with."""
    word = F.regexp_extract(current, r"(\S+)-\s*$", 1)
    goes_on = F.ltrim(following).rlike(r"^\p{Ll}")
    acronym = (word == F.upper(word)) & word.rlike(r"\p{Lu}") & (F.length(word) >= 2)
    return F.coalesce(F.rtrim(current).endswith("-") & current.endswith("-") & goes_on & ~F.lower(word).isin(*HYPHEN_STAYS) & ~acronym, F.lit(False))


def join_hyphenated(current: Column, following: Column) -> Column:
    """Both texts in one: joined without the hyphen where it only broke the line, else with a space."""
    whole = F.concat(F.regexp_replace(F.rtrim(current), "-$", ""), F.ltrim(following))
    return F.when(joins_hyphen(current, following), whole).otherwise(F.concat_ws(" ", current, following))


def is_figure_caption(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.coalesce((F.length(t) >= 5) & t.rlike(rf"^(?:{FIGURE_WORDS}){CAPTION_TAIL}"), F.lit(False))


def is_table_caption(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.coalesce((F.length(t) >= 5) & t.rlike(rf"^(?:{TABLE_WORDS}){CAPTION_TAIL}"), F.lit(False))


def figure_label(caption: Column) -> Column:
    """``Figure 1.1`` from the beginning of a caption, else null."""
    number = F.regexp_extract(caption, r"(?i)^(?:figure|fig\.?)\s+([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(number != "", F.concat(F.lit("Figure "), number))


def normal_label(label: Column) -> Column:
    return collapse_space(F.regexp_replace(label, r"(?i)^(?:figure|fig\.?)", "Figure"))


def table_mentions(text: Column) -> Column:
    """Array of ``Table n. rest`` for every table keyword in a text."""
    pattern = r"(?i)\btable\s+([0-9]+|[A-Z]|[IVX]+)[.:]\s*([^\n]*)"
    numbers, rests = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(numbers, rests, lambda n, r: F.trim(F.concat(F.lit("Table "), n, F.lit(". "), F.trim(r))))


def slug(text: Column, longest: int = 15) -> Column:
    """An XML id: lower case, hyphens, never empty and never beginning with a digit."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.left(s, F.lit(longest)), "-+$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("sec-"), s)).when(s == "", "section").otherwise(F.coalesce(s, F.lit("section")))


def book_id(title: Column) -> Column:
    s = F.regexp_replace(title, "[^a-zA-Z0-9]+", "_")
    s = F.when(s.rlike("^[^A-Za-z]"), F.concat(F.lit("book_"), s)).otherwise(s)
    s = F.regexp_replace(F.left(s, F.lit(50)), "_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "book1").otherwise(s)


def appendix_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA; below 1 -> A."""
    start = F.struct(F.greatest(n, F.lit(1)).cast("bigint").alias("n"), F.lit("").alias("s"))

    def step(a: Column, _: Column) -> Column:
        left = a["n"] - 1
        more = F.struct(F.floor(left / 26).cast("bigint").alias("n"), F.concat(F.char(65 + left % 26), a["s"]).alias("s"))
        return F.when(a["n"] > 0, more).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"])


def chapter_label(n: Column) -> Column:
    return F.when(n == 0, "intro").otherwise(n.cast("string"))


def chapter_code(entity: Column, kind: Column, section_type: Column, title: Column) -> Column:
    """Struct of the code in file names and the label."""
    t = F.lower(F.coalesce(section_type, F.lit("")))
    letter = F.upper(F.regexp_extract(F.coalesce(title, F.lit("")), r"(?i)appendix\s+([A-Z])", 1))
    letter = F.when(letter == "", "A").otherwise(letter)
    number = F.regexp_extract(entity, "(?i)^ch([0-9]+)", 1)
    pair = lambda a, b: F.struct(a.alias("code"), b.alias("label"))
    whole = F.when(number != "", number.try_cast("int")).otherwise(1)
    return (
        F.when((kind == "toc") | (t == "toc"), pair(F.lit("TOC"), F.lit("TOC"))).when(t == "index", pair(F.lit("Index"), F.lit("Index")))
        .when(t == "appendix", pair(F.concat(F.lit("Appendix"), letter), F.concat(F.lit("Appendix "), letter)))
        .otherwise(pair(F.concat(F.lit("Ch"), F.lpad(whole.cast("string"), 4, "0")), whole.cast("string")))
    )


def isbn_from_name(name: Column, fallback: Column) -> Column:
    """The first ISBN in a file name, else its cleaned stem, else ``fallback``."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    found = F.regexp_extract(stem, "(97[89][0-9]{10}|[0-9]{9}[0-9Xx])", 1)
    clean = F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "")
    return F.when(found != "", found).when(clean != "", clean).otherwise(fallback)


def isbn_clean(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^0-9X]", "")


def split_authors(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,;]|\sand\s"), lambda x: F.trim(x)), lambda a: a != ""))


def field_name(raw: Column) -> Column:
    """The metadata field that a spreadsheet heading means, else null."""
    return F.element_at(_map({k: v for v, names in FIELD_NAMES.items() for k in names.split()}), F.lower(F.trim(raw)))


def year(text: Column) -> Column:
    found = F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1)
    return F.when(found != "", found)


def file_type(name: Column) -> Column:
    return F.coalesce(F.element_at(_map(FILE_TYPES), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))), F.lit("other"))


def error_kind(message: Column, detailed: bool = True) -> Column:
    """The kind of a validation message; the plain form has no duplicate ids and entities."""
    low, out = F.lower(message), F.lit("DTD Validation Error")
    for marks, kind in reversed(ERROR_MARKS):
        if detailed or kind not in ("Duplicate ID", "Entity Error"):
            out = F.when(low.rlike(marks), kind).otherwise(out)
    return out


def error_text(message: Column) -> Column:
    out = message
    for pattern, new in (
        (r"Element (\w+): ", "The <$1> element "), (r"No declaration for element (\w+)", "The element <$1> is not defined in the DTD"),
        (r"No declaration for attribute (\w+) of element (\w+)", 'The attribute "$1" is not allowed in the <$2> element'), ("does not follow the DTD", "does not match what the DTD expects"),
        ("content model", "allowed content"), (r"Expecting \(([^)]+)\)", "Expected: $1"), (r"got \(([^)]+)\)", "but found: $1"),
    ):
        out = F.regexp_replace(out, pattern, new)
    return out


def reference_error_kind(message: Column) -> Column:
    return (
        F.when(message.contains("Final resource not found"), "Missing Resource").when(message.contains("Unresolved link"), "Broken Link")
        .when(message.contains("has no final name"), "Missing Resource Name").otherwise("Reference Error")
    )


def human_size(n: Column) -> Column:
    of = lambda unit, name: F.concat(F.format_string("%.1f", F.bround(n / unit, 1)), F.lit(name))
    return F.when(n >= 1048576, of(1048576, "MB")).when(n >= 1024, of(1024, "KB")).otherwise(F.concat(n.cast("string"), F.lit("B")))


def is_roman(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[ivxlcdm]+$"), F.lit(False))


def is_page_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("(?i)^(?:[0-9]{1,4}|[ivxlcdm]+)$"), F.lit(False))


def is_bullet(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(t.rlike(rf"(?i)^(?:[{BULLETS}]$|[{BULLETS}]\s+|[0-9]+[.)]\s+|[a-z][.)]\s+|\([0-9]+\)\s+|\([a-z]\)\s+|[ivxlcdm]+[.)]\s+)"), F.lit(False))


def list_item(text: Column, markers: str = "•●○■") -> Column:
    """Struct (kind, content) of a list item, else null. An initial before a name is none."""
    t = F.ltrim(text)
    bullet = F.trim(F.regexp_extract(t, rf"^[{markers}](.*)$", 1))
    order = r"^(?:\(?[0-9]{1,3}[.)]|[A-HJ-Za-hj-z][.)])\s+(?=\w{2,})"
    rest = F.trim(F.regexp_replace(t, order, ""))
    initial = t.rlike(r"^[A-HJ-Z][.)]\s+\p{Lu}\S{2,}")
    made = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("content"))
    return F.when(F.length(t) < 3, None).when(bullet != "", made("itemized", bullet)).when(t.rlike(order) & ~initial & (rest != ""), made("ordered", rest))


def heading_kind(text: Column, size: Column, body: Column, top: Column, page_height: Column, page: Column) -> Column:
    """The first kind of heading that a line is: part, glossary, index, toc, book_title, chapter, section, caption, else null."""
    t = F.trim(text)
    words = F.size(F.array_remove(F.split(t, r"\s+"), ""))
    heading = size >= body + 2.0
    part = t.rlike(rf"(?i)^part\s+(?:[ivxlcdm]+|[0-9]+|{PART_NUMBERS.replace(' ', '|')})\b") & heading & (words <= 8)
    title = (page <= 2) & (top <= page_height * 0.45) & ((size >= body + 6) | ((size >= body + 4) & (words <= 12)))
    named = t.rlike(r"(?i)\bchapter\b|^(?:chapter|chap\.|unit|lesson|module)\b")
    chapter = heading & (named | (top <= page_height * 0.45) | (words <= 10))
    capitals = (t == F.upper(t)) & (t != F.lower(t))
    section = t.rlike(r"(?i)^(?:section|sec\.)\b") | ((size >= body + 1.5) & (words <= 14)) | ((words <= 8) & capitals & (size >= body))
    return (
        F.when(t == "", None).when(part, "part").when(t.rlike(r"(?i)^glossary\b") & heading, "glossary").when(t.rlike(r"(?i)^index\b") & heading, "index")
        .when(t.rlike("(?i)^table of contents$"), "toc").when(title, "book_title").when(chapter, "chapter").when(section, "section")
        .when(t.rlike(r"(?i)^(?:figure|fig\.|table)\s+[0-9]+"), "caption")
    )


def is_front_matter(text: Column, page: Column) -> Column:
    low = F.trim(F.lower(text))
    early = (page < 30) & (low.rlike("|".join(FRONT_MATTER)) | (F.length(text) < 200))
    return F.coalesce(~low.rlike(r"\bchapter\s+[0-9]+\b") & early, F.lit(False))


def split_references(text: Column) -> Column:
    """Numbered references of a merged text; empty if it is no such list."""
    parts = F.filter(F.transform(F.split(text, r"(?<=\.)\s+(?=[0-9]{1,3}\.)"), lambda x: F.trim(x)), lambda p: p != "")
    numbered = F.size(F.filter(parts, lambda p: p.rlike(r"^[0-9]{1,3}\.")))
    return F.when((F.size(parts) > 1) & (numbered >= F.size(parts) * 0.5), parts).otherwise(F.array().cast("array<string>"))


def font_role(name: Column) -> Column:
    low = F.lower(name)
    bold, italic = low.rlike("bold|heavy|black|demi"), low.rlike("italic|oblique|slant")
    return F.when(bold & italic, "bold-italic").when(bold, "bold").when(italic, "italic")


def font_family(name: Column) -> Column:
    cut = F.regexp_replace(name, "(?i)[-_]?(?:Bold|Italic|BoldItalic|Light|Medium|Regular|Oblique|Black|Thin|Semi|Extra|Cond|Condensed)+$", "")
    cut = F.regexp_replace(cut, "[-_]+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").when(cut == "", name).otherwise(cut)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe-table row; a separator row has none."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))
    return F.when(F.trim(line).rlike(r"^\|?[\s:|-]+\|?$") & line.contains("-"), F.array().cast("array<string>")).otherwise(cells)


def markdown_kind(line: Column) -> Column:
    t = F.trim(line)
    level = F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    return (
        F.when(t == "", "blank").when(t.startswith("```"), "fence").when(level > 0, F.concat(F.lit("h"), level.cast("string"))).when(t.rlike(r"^!\[[^\]]*\]\([^)]*\)"), "image")
        .when(t.rlike(r"^[-*+•]\s+"), "bullet").when(t.rlike(r"^[0-9]+[.)]\s+"), "ordered").when(t.startswith("|") | t.rlike(r"^[^|]+\|[^|]+\|"), "table").otherwise("text")
    )


def size_heading(text: Column, size: Column) -> Column:
    return F.when(size >= 18, F.concat(F.lit("# "), text)).when(size >= 14, F.concat(F.lit("## "), text)).otherwise(text)


def lenient_entities(text: Column) -> Column:
    """Entities that XML does not define, made harmless for a lenient parser."""
    return F.regexp_replace(text, "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def link_kind(href: Column) -> Column:
    return F.when(href.rlike("(?i)^(?:https?|ftp|mailto):"), "external").otherwise("internal")


def image_name(chapter: Column, number: Column, extension: Column) -> Column:
    return F.concat(chapter, F.lit("_img"), F.lpad(number.cast("string"), 3, "0"), F.lit("."), F.regexp_replace(extension, r"^\.+", ""))
