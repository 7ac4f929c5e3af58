"""Queries over the string functions; texts are made from table columns so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from .adapters import table


def _pick(key, *values):
    """One of the texts, by the key."""
    return F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values: str) -> str:
    """The same in SQL; a value beginning with = is an expression."""
    quoted = [v[1:] if v.startswith("=") else "'" + v.replace("'", "''") + "'" for v in values]
    return "CASE " + f"{key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


_part = lambda s, d: table(s, d, "part")
_docs = lambda s, d: table(s, d, "documents")
ENTITY_TEXTS = ("a &mdash; b", "x &#8212; y", "5 &#60; 6 &amp; 7", "&nbsp;&copy; &Sigma;&sum;", "plain & simple", "&#160;&#128512;;", "&unknown; &#38;")
CAPTIONS = ("Figure 1. System", "see Figure 1.", "Fig 2-3: x", "Table 4 shows it", "Photo 7", "Appendix B2. Data", "IMAGE 12a) view", "Tableau 3: cas")
TITLES = ("The **Bold** Story", "A __fine__ day", "\\*kept\\*", "one *two* three", "snake_case_name", "plain")
REFERENCES = ("1. First ref. 2. Second ref. 3. Third ref.", "No list here.", "Alpha. 12. Beta. Gamma.")
JOINS = (("compu-", "tation of"), ("self-", "driving cars"), ("AI-", "powered"), ("pre-", "Process"), ("plain", "text"), ("re-", "search"))
HEADINGS = ("Part IV: Beginnings", "Chapter 3", "Index", "Glossary of terms", "Table of Contents", "SECTION A", "Figure 3 Plan", "An ordinary line of words that goes on and on until it ends", "")
FONTS = ("Times-Bold", "Arial-BoldItalic", "Helvetica", "Garamond_Oblique", "Futura-CondensedBlack", "")
MESSAGES = ("Element para: content model does not follow the DTD", "No declaration for element foo", "ID ch1 already defined", "Entity x missing", "Element row is empty", "Something else", "attribute not allowed")
LISTS = ("1. First thing", "A. Smith wrote", "• a bullet", "(3) third", "b) lower", "I. Roman", "x", "plain words")
LINES = ("# Title", "### Deep", "- item", "2. second", "```python", "| a | b |", "![alt](x.png)", "text only", "")



def _over(values, build):
    return lambda s, d: _part(s, d).select("p_partkey", *build(_pick("p_partkey", *values)))


def _cases(values, **columns):
    """Oracle for a function of a few texts: the answers worked out by hand, in the order of the texts."""
    out = ", ".join(f"{_pick_sql('p_partkey', *answers)} AS {name}" for name, answers in columns.items())
    return f"SELECT p_partkey, {out} FROM part"



_HEAD_ARGS = (16.0, 11.0, 300.0, 800.0, 5)  # size, body size, top, page height, page
QUERIES = {
    "str_01_xml_chars": lambda s, d: _part(s, d).select("p_partkey", F.length(S.strip_invalid_xml(F.concat(F.char(F.col("p_partkey") % 32), F.col("p_name"), F.lit("￾\U0001f600")))).alias("n")),
    "str_02_entities": _over(ENTITY_TEXTS, lambda t: [S.decode_entities(t).alias("text")]),
    "str_03_escape": lambda s, d: _docs(s, d).select("doc_id", F.sha2(S.escape_content(F.col("text")), 256).alias("content"), F.sha2(S.escape_attribute(F.col("text")), 256).alias("attribute")),
    "str_03_escape_cases": _over(ENTITY_TEXTS, lambda t: [S.escape_ampersands(t).alias("text"), S.escape_all(t).alias("full_text")]),
    "str_04_titles": _over(TITLES, lambda t: [S.plain_title(t).alias("title")]),
    "str_05_inline": _over(TITLES, lambda t: [S.inline_markup(F.concat(t, F.lit(" H<sub>2</sub>O `a<b` ____ & x"))).alias("text")]),
    "str_06_font_note": lambda s, d: _part(s, d).select("p_partkey", S.strip_font_note(F.concat(F.col("p_name"), F.lit(" <!-- font:"), F.col("p_size").cast("string"), F.lit(" --> "))).alias("title")),
    "str_08_hyphens": lambda s, d: _part(s, d).select("p_partkey", S.join_hyphenated(_pick("p_partkey", *(a for a, _ in JOINS)), _pick("p_partkey", *(b for _, b in JOINS))).alias("text")),
    "str_09_captions": _over(CAPTIONS, lambda t: [S.is_figure_caption(t).alias("figure"), S.is_table_caption(t).alias("is_table")]),
    "str_10_labels": _over(CAPTIONS, lambda t: [S.figure_label(t).alias("label"), S.normal_label(t).alias("normal")]),
    "str_11_table_mentions": lambda s, d: _part(s, d).select("p_partkey", F.array_join(S.table_mentions(F.concat(F.lit("as table "), F.col("p_size").cast("string"), F.lit(": "), F.col("p_name"), F.lit("\nand Table X. end"))), "|").alias("found")),
    "str_12_slugs": lambda s, d: _part(s, d).select("p_partkey", S.slug(F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_name"))).alias("slug"), S.slug(F.concat(F.lit("  "), F.col("p_name"), F.lit(" & co"))).alias("other"), S.book_id(F.concat_ws("", F.col("p_type"), F.col("p_name"))).alias("book")),
    "str_13_appendix": lambda s, d: _part(s, d).select("p_partkey", S.appendix_letters(F.col("p_partkey")).alias("letters")),
    "str_14_chapters": lambda s, d: _part(s, d).select("p_partkey", S.chapter_label(F.col("p_partkey") % 5).alias("label"), S.chapter_code(F.concat(F.lit("ch"), F.col("p_size").cast("string")), F.lit("chapter"), _pick("p_partkey", "", "toc", "index", "appendix"), F.lit("Appendix C: More")).alias("c")).select("p_partkey", "label", F.col("c.code").alias("code"), F.col("c.label").alias("shown")),
    "str_15_isbn": lambda s, d: _part(s, d).select("p_partkey", S.isbn_from_name(_pick("p_partkey", "9798275082845.pdf", "my-book-9798275082845_x.pdf", "030640615X.tar.gz", "A book!.pdf", "!!.pdf"), F.lit("fallback")).alias("isbn")),
    "str_16_isbn_clean": lambda s, d: _part(s, d).select("p_partkey", S.isbn_clean(F.concat(F.lit("isbn 978-"), F.col("p_partkey").cast("string"), F.lit("-x"))).alias("isbn")),
    "str_17_authors": lambda s, d: _part(s, d).select("p_partkey", F.array_join(S.split_authors(F.concat_ws("; ", F.col("p_brand"), F.concat_ws(" and ", F.col("p_brand"), F.col("p_type")), F.lit(""))), "|").alias("authors")),
    "str_18_fields": _over(("ISBN-13", " Title ", "by", "Year", "holder", "other"), lambda t: [S.field_name(t).alias("field")]),
    "dt_04_year": lambda s, d: _part(s, d).select("p_partkey", S.year(F.concat(F.lit("(c) "), (F.col("p_partkey") % 400 + 1750).cast("string"), F.lit(" by"))).alias("year")),
    "str_19_file_types": _over(("a.pdf", "b.XML", "c.tar.zip", "noext", "d.jpeg", "e.json"), lambda t: [S.file_type(t).alias("kind")]),
    "str_20_errors": _over(MESSAGES, lambda t: [S.error_kind(t).alias("kind"), S.error_kind(t, False).alias("plain_kind"), S.error_text(t).alias("text")]),
    "str_21_sizes": lambda s, d: _part(s, d).select("p_partkey", S.human_size(F.col("p_partkey") * F.col("p_partkey") * 7).alias("size")),
    "str_22_roman": lambda s, d: _part(s, d).select("p_partkey", S.is_roman(_pick("p_partkey", "xiv", "MCM", "x1", "", "mild")).alias("roman"), S.is_page_number(_pick("p_partkey", " 12 ", "12345", "iv", "a")).alias("number")),
    "str_23_list_items": lambda s, d: _part(s, d).select("p_partkey", S.list_item(_pick("p_partkey", *LISTS)).alias("i")).select("p_partkey", F.col("i.kind").alias("kind"), F.col("i.content").alias("content")),
    "str_24_headings": _over(HEADINGS, lambda t: [S.heading_kind(t, *map(F.lit, _HEAD_ARGS)).alias("kind"), S.is_front_matter(t, F.lit(40)).alias("front")]),
    "str_25_references": _over(REFERENCES, lambda t: [F.array_join(S.split_references(t), "|").alias("items")]),
    "str_26_fonts": _over(FONTS, lambda t: [S.font_role(t).alias("role"), S.font_family(t).alias("family")]),
    "str_27_spaces": lambda s, d: _docs(s, d).select("doc_id", F.length(S.collapse_space(F.col("text"))).alias("n")),
    "str_29_pipe_cells": lambda s, d: _part(s, d).select("p_partkey", F.array_join(S.pipe_cells(F.concat(F.lit("| "), F.col("p_brand"), F.lit(" | "), F.col("p_type"), F.lit(" |"))), ";").alias("cells")),
    "str_30_markdown": _over(LINES, lambda t: [S.markdown_kind(t).alias("kind")]),
    "str_31_size_headings": lambda s, d: _part(s, d).select("p_partkey", S.size_heading(F.col("p_name"), F.col("p_size")).alias("line")),
    "str_32_bullets": _over(LISTS, lambda t: [S.is_bullet(t).alias("bullet")]),
    "str_33_lenient": _over(ENTITY_TEXTS, lambda t: [S.lenient_entities(t).alias("text")]),
    "flt_10_links": lambda s, d: table(s, d, "pages").select("page_id", S.link_kind(F.col("url")).alias("kind"), S.link_kind(F.lit("ch1.xml#a")).alias("other")),
    "win_27_image_names": lambda s, d: _part(s, d).select("p_partkey", S.image_name(F.concat(F.lit("Ch"), F.lpad(F.col("p_size").cast("string"), 4, "0")), F.col("p_partkey") % 1000, F.lit(".png")).alias("name")),
}

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_DECODED = ("a — b", "x — y", "5 &#60; 6 &amp; 7", " © ΣΣ", "plain & simple", " \U0001f600;", "&unknown; &#38;")
ORACLE_SQL = {
    "str_01_xml_chars": "SELECT p_partkey, CAST(length(p_name) + 1 + CASE WHEN p_partkey % 32 IN (9, 10, 13) THEN 1 ELSE 0 END AS INTEGER) AS n FROM part",
    "str_02_entities": _cases(ENTITY_TEXTS, text=_DECODED),
    "str_03_escape": f"SELECT doc_id, sha256({_ESCAPED.format('text')}) AS content, sha256(replace(replace({_ESCAPED.format('text')}, '\"', '&quot;'), '''', '&apos;')) AS attribute FROM documents",
    "str_03_escape_cases": _cases(ENTITY_TEXTS, text=("a — b", "x — y", "5 &amp;#60; 6 &amp; 7", " © ΣΣ", "plain &amp; simple", " \U0001f600;", "&amp;unknown; &amp;#38;"), full_text=("a — b", "x — y", "5 &amp;#60; 6 &amp;amp; 7", " © ΣΣ", "plain &amp; simple", " \U0001f600;", "&amp;unknown; &amp;#38;")),
    "str_04_titles": _cases(TITLES, title=("The Bold Story", "A fine day", "kept", "one two three", "snakecasename", "plain")),
    "str_05_inline": _cases(TITLES, text=tuple(t + ' H<subscript>2</subscript>O <literal>a&lt;b</literal> ____ &amp; x' for t in ('The <emphasis role="bold">Bold</emphasis> Story', "A __fine__ day", '<emphasis role="italics">kept</emphasis>', 'one <emphasis role="italics">two</emphasis> three', 'snake<emphasis role="italics">case</emphasis>name', "plain"))),
    "str_06_font_note": "SELECT p_partkey, trim(p_name) AS title FROM part",
    "str_08_hyphens": _cases(JOINS, text=("computation of", "self- driving cars", "AI- powered", "pre- Process", "plain text", "research")),
    "str_10_labels": _cases(CAPTIONS, label=("Figure 1", "=NULL", "Figure 2", "=NULL", "=NULL", "=NULL", "=NULL", "=NULL"), normal=("Figure 1. System", "see Figure 1.", "Figure 2-3: x", "Table 4 shows it", "Photo 7", "Appendix B2. Data", "IMAGE 12a) view", "Tableau 3: cas")),
    "str_09_captions": "SELECT p_partkey, p_partkey % 8 IN (0, 2, 6) AS figure, p_partkey % 8 IN (3, 5, 7) AS is_table FROM part",
    "str_11_table_mentions": "SELECT p_partkey, concat('Table ', p_size, '. ', trim(p_name), '|Table X. end') AS found FROM part",
    "str_12_slugs": """WITH a AS (SELECT *, trim(regexp_replace(lower(concat(p_size, ' ', p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS x, trim(regexp_replace(lower(concat('  ', p_name, ' & co')), '[^a-z0-9]+', '-', 'g'), '-') AS y, rtrim(left(regexp_replace(concat(p_type, p_name), '[^a-zA-Z0-9]+', '_', 'g'), 50), '_') AS b FROM part)
      SELECT p_partkey, concat('sec-', rtrim(left(x, 15), '-')) AS slug, rtrim(left(y, 15), '-') AS other, b AS book FROM a""",
    "str_13_appendix": "SELECT p_partkey, concat(CASE WHEN p > 18278 THEN chr(CAST(65 + ((p - 18279) // 17576) % 26 AS INTEGER)) ELSE '' END, CASE WHEN p > 702 THEN chr(CAST(65 + ((p - 703) // 676) % 26 AS INTEGER)) ELSE '' END, CASE WHEN p > 26 THEN chr(CAST(65 + ((p - 27) // 26) % 26 AS INTEGER)) ELSE '' END, chr(CAST(65 + (p - 1) % 26 AS INTEGER))) AS letters FROM (SELECT p_partkey, greatest(p_partkey, 1) AS p FROM part)",
    "str_14_chapters": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'intro' ELSE CAST(p_partkey % 5 AS VARCHAR) END AS label, CASE p_partkey % 4 WHEN 0 THEN concat('Ch', lpad(CAST(p_size AS VARCHAR), 4, '0')) WHEN 1 THEN 'TOC' WHEN 2 THEN 'Index' ELSE 'AppendixC' END AS code, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'TOC' WHEN 2 THEN 'Index' ELSE 'Appendix C' END AS shown FROM part",
    "str_15_isbn": _cases(range(5), isbn=("9798275082845", "9798275082845", "030640615X", "Abook", "fallback")),
    "str_16_isbn_clean": "SELECT p_partkey, concat('978', p_partkey, 'X') AS isbn FROM part",
    "str_17_authors": "SELECT p_partkey, concat(p_brand, '|', p_type) AS authors FROM part",
    "str_18_fields": _cases(range(6), field=("isbn", "title", "authors", "pubdate", "copyright_holder", "=NULL")),
    "dt_04_year": "SELECT p_partkey, CASE WHEN p_partkey % 400 + 1750 BETWEEN 1900 AND 2099 THEN CAST(p_partkey % 400 + 1750 AS VARCHAR) END AS year FROM part",
    "str_19_file_types": _cases(range(6), kind=("source", "output", "package", "other", "image", "metadata")),
    "str_20_errors": _cases(MESSAGES, kind=("Invalid Content Model", "Undeclared Element", "Duplicate ID", "Missing Attribute", "Empty Element Error", "DTD Validation Error", "Invalid Element"), plain_kind=("Invalid Content Model", "Undeclared Element", "DTD Validation Error", "Missing Attribute", "Empty Element Error", "DTD Validation Error", "Invalid Element"), text=("The <para> element allowed content does not match what the DTD expects", "The element <foo> is not defined in the DTD", *MESSAGES[2:])),
    "str_21_sizes": "SELECT p_partkey, CASE WHEN n >= 1048576 THEN concat(format('{:.1f}', n / 1048576.0), 'MB') WHEN n >= 1024 THEN concat(format('{:.1f}', round_even(n / 1024.0, 1)), 'KB') ELSE concat(n, 'B') END AS size FROM (SELECT p_partkey, p_partkey * p_partkey * 7 AS n FROM part)",
    "str_22_roman": "SELECT p_partkey, p_partkey % 5 IN (0, 1, 4) AS roman, p_partkey % 4 IN (0, 2) AS number FROM part",
    "str_23_list_items": _cases(LISTS, kind=("ordered", "=NULL", "itemized", "ordered", "ordered", "=NULL", "=NULL", "=NULL"), content=("First thing", "=NULL", "a bullet", "third", "lower", "=NULL", "=NULL", "=NULL")),
    "str_24_headings": _cases(HEADINGS, kind=("part", "chapter", "index", "glossary", "toc", "chapter", "chapter", "chapter", "=NULL"), front=("=false",) * 9),
    "str_25_references": _cases(REFERENCES, items=("1. First ref.|2. Second ref.|3. Third ref.", "", "Alpha.|12. Beta. Gamma.")),
    "str_26_fonts": _cases(FONTS, role=("bold", "bold-italic", "=NULL", "italic", "bold", "=NULL"), family=("Times", "Arial", "Helvetica", "Garamond", "Futura", "Unknown")),
    "str_27_spaces": "SELECT doc_id, CAST(length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS INTEGER) AS n FROM documents",
    "str_29_pipe_cells": "SELECT p_partkey, concat(p_brand, ';', p_type) AS cells FROM part",
    "str_30_markdown": _cases(LINES, kind=("h1", "h3", "bullet", "ordered", "fence", "table", "image", "text", "blank")),
    "str_31_size_headings": "SELECT p_partkey, concat(CASE WHEN p_size >= 18 THEN '# ' WHEN p_size >= 14 THEN '## ' ELSE '' END, p_name) AS line FROM part",
    "str_32_bullets": "SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 3, 4, 5) AS bullet FROM part",
    "str_33_lenient": _cases(ENTITY_TEXTS, text=("a &amp;mdash; b", "x &#8212; y", "5 &#60; 6 &amp; 7", "&amp;nbsp;&amp;copy; &amp;Sigma;&amp;sum;", "plain &amp; simple", "&#160;&#128512;;", "&amp;unknown; &#38;")),
    "flt_10_links": "SELECT page_id, 'external' AS kind, 'internal' AS other FROM pages",
    "win_27_image_names": "SELECT p_partkey, concat('Ch', lpad(CAST(p_size AS VARCHAR), 4, '0'), '_img', lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'), '.png') AS name FROM part",
}
