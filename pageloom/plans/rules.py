"""Queries over rule sets, extension points, stores and spreadsheets of metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dtd as D
from ..operators import markup as M
from ..operators import markup_variants as V
from ..sources import extension as X
from ..sources import readers as R
from ..sources import rules as U
from ..sources import storage as G
from ..sources import writers as K
from .adapters import table
from .documents import _CHAIN_COUNTS, _LATE, _LINES, _books, _chapters, _lines, scratch


def _built(blocks: dict[int, str], head: str):
    """A chapter for each order, with a block for each of its lines by the remainder of the line number."""

    def chapters(s, d):
        number = F.col("o.l_linenumber").cast("int") % len(blocks)
        block = F.element_at(F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)), number)
        parts = F.array_sort(F.collect_list(F.struct("o", block.alias("b"))))
        xml = F.concat(F.lit("<chapter>" + head), F.array_join(F.transform(parts, lambda p: p["b"]), ""), F.lit("</chapter>"))
        return _lines(s, d).groupBy(F.col("l_orderkey").alias("chapter")).agg(xml.alias("xml"))

    return chapters


_RICH = {
    0: "<informalfigure><title>F</title><mediaobject><imageobject><imagedata fileref='a.png'/></imageobject></mediaobject></informalfigure>",
    1: "<table><title>T</title><tr><td>a</td><td>b</td></tr></table>",
    2: "<bridgehead>H</bridgehead><para>x</para>",
    3: "<mediaobject/>",
    4: "<itemizedlist><para>x</para></itemizedlist>",
    5: "<para>two  spaces</para><figure><title>G</title></figure>",
}
_FAULTY = {
    0: "<figure><title>G</title><imagedata/></figure>",
    1: "<figure><title>Table of things</title><mediaobject><textobject>not available</textobject></mediaobject></figure>",
    2: "<para>a<para>in</para>b</para>",
    3: "<table><tgroup><tbody><row/><row><entry>x</entry><entry>y</entry></row></tbody></tgroup></table>",
    4: "<mediaobject><textobject><phrase>no image</phrase></textobject></mediaobject>",
    5: "<sect1><para>s</para><title>T</title></sect1>",
    6: "<div>t<span>u</span></div><p>z</p>",
}
_rich, _faulty = _built(_RICH, ""), _built(_FAULTY, "<title>C</title>")


def _counted(n: int) -> str:
    """Blocks of each remainder in each chapter."""
    return f"l AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem), g AS (SELECT l_orderkey AS chapter, {', '.join(f'count(*) FILTER (l_linenumber % {n} = {k}) AS k{k}' for k in range(n))} FROM l GROUP BY 1)"


def _sums(n: int, *rows: tuple[str, str, str]) -> str:
    return f"WITH {_counted(n)} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{fix}' AS fix, '{kind}' AS kind, CAST(sum({expr}) AS BIGINT) AS n FROM g" for fix, kind, expr in rows) + ") WHERE n > 0"


def _fix(chapters, *names, rewrites=None):
    return lambda s, d: M.fix_counts(M.rewrite(chapters(s, d), fixes=list(names) or None, rewrites=rewrites))


def _after_fixes(s, d):
    """Chapters, their fixes, and their errors before and after the full chain."""
    return U.ChainFixer().fix_and_validate(_chapters(s, d), U.RuleValidator()).agg(
        F.count(F.lit(1)).alias("chapters"), F.sum("n_fixes").cast("bigint").alias("fixes"), F.sum("before").cast("bigint").alias("before"), F.sum("after").cast("bigint").alias("after")
    )


#: A small document type of the chapters that the queries build.
_DTD = """<!ENTITY % blocks "para | section | p | link | imagedata">
<!ELEMENT chapter (title?, (%blocks;)*)> <!ELEMENT section (title, para+)> <!ELEMENT title (#PCDATA)> <!ELEMENT para (#PCDATA | link)*>
<!ELEMENT link (#PCDATA)> <!ELEMENT imagedata EMPTY> <!ATTLIST link linkend IDREF #REQUIRED> <!ATTLIST imagedata fileref CDATA #REQUIRED>"""


def _by_dtd(s, d):
    return D.dtd_errors(M.node_table(_chapters(s, d)), D.models(s, _DTD)).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def _chain(s, d):
    """Adapter, fixer without the link rule, validator: the errors that are left, by type."""
    names = [n for n in M.CHAIN if n != "fix_15_links"]
    chain = X.Chain().register("adapter", "chapters", lambda df: df.select("chapter", "xml")).register("fixer", "fix", lambda df: M.rewrite(df, fixes=names)).register("validator", "check", lambda df: U.RuleValidator().errors(df))
    return chain.run(_chapters(s, d)).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def _transformed(s, d):
    steps = X.Transformer().load(lambda df: M.rewrite(df, fixes=["fix_13_excluded", "fix_01_titles"]).select("chapter", "xml"), "tags").load(lambda df: M.rewrite(df, fixes=["fix_03_figures", "fix_11_attributes"]).select("chapter", "xml"), "media")
    return steps.transform_and_validate(_chapters(s, d), U.RuleValidator()).groupBy(F.lit(",".join(steps.names)).alias("steps"), "is_valid").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n_errors").cast("bigint").alias("errors"))


def _packaged(s, d):
    media = table(s, d, "nation").select(F.col("n_regionkey").alias("book"), F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ".png").otherwise(".exe")).alias("name"))
    return U.BookPackager().package(_books(s, d), media).select("book", "n_files", F.array_join("media", ",").alias("media"))


def _stored(kind):
    def query(s, d):
        folder = scratch(s)
        rows = table(s, d, "nation").select(F.concat(F.lit("97800"), F.col("n_regionkey").cast("string")).alias("isbn"), F.concat(F.lower("n_name"), F.lit(".xml")).alias("filename"), F.col("n_name").cast("binary").alias("content"))
        if kind == "folder":
            rows.select("isbn", F.col("content").cast("string").alias("value")).write.partitionBy("isbn").text(f"{folder}/plain")
            return G.storage(s, "folder", f"{folder}/plain").files().filter("filename LIKE '%.txt'").groupBy(F.substring_index("isbn", "=", -1).alias("isbn")).agg(F.sum("length").cast("bigint").alias("bytes"))
        store = G.storage(s, "table", f"{folder}/store")
        store.put(rows)
        store.put(rows.filter("isbn = '978002'").withColumn("content", F.encode(F.lit("new"), "UTF-8")))
        store.delete("978003")
        return store.statistics()

    return query


def _book_sheet(s, d):
    """Metadata workbooks, one for each region, in both layouts by the parity of its key."""
    down = lambda r: [["Field", "Value"], ["ISBN", f"978-{r['r_regionkey']}"], ["Title", r["r_name"]], ["Author", "Ann; Bob"], ["Year", "2001"]]
    across = lambda r: [["isbn", "title", "author", "year"], [f"978-{r['r_regionkey']}", r["r_name"], "Ann; Bob", "2001"]]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    files = []
    for r in table(s, d, "region").collect():  # a handful of workbooks that the query makes itself
        rows = (across if r["r_regionkey"] % 2 else down)(r)
        cells = "".join(f"<row r='{i + 1}'>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows))
        files.append((str(r["r_regionkey"]), bytearray(K.package_bytes([("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="M" sheetId="1"/></sheets></workbook>'), ("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")]))))
    pairs = R.metadata_pairs(R.sheet_cells(s.createDataFrame(files, "path string, content binary")))
    return R.book_records(pairs, "path").select(F.col("path").cast("int").alias("region"), "isbn", "title", F.array_join("authors", "|").alias("authors"), F.coalesce("pubdate", "copyright_year").alias("year"))


QUERIES = {
    "fix_02_formal": _fix(_rich, "fix_02_formal"), "fix_05_cals": _fix(_rich, "fix_05_cals"), "fix_07_bridgeheads": _fix(_rich, "fix_07_bridgeheads"), "fix_08_media": _fix(_rich, "fix_08_media"),
    "fix_09_models": _fix(_rich, "fix_09_models", "fix_09_order"), "fix_14_space": _fix(_rich, "fix_14_space"),
    "fix_16_core": _fix(_faulty, rewrites=V.CORE), "fix_17_targeted": _fix(_faulty, rewrites=V.TARGETED),
    "val_01_dtd": _by_dtd, "val_01_after_fixes": _after_fixes, "udf_02_chain": _chain,
    "udf_03_validator": lambda s, d: U.RuleValidator().validate(_chapters(s, d)).groupBy("is_valid").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n_errors").cast("bigint").alias("errors"), F.sum(F.coalesce(F.col("by_type")["Broken Link"], F.lit(0))).cast("bigint").alias("links")),
    "udf_04_fixer": lambda s, d: U.ChainFixer("core").fix(_faulty(s, d)).select("chapter", F.size("fixes").alias("fixes"), F.size(F.array_distinct(F.transform("fixes", lambda f: f["kind"]))).alias("kinds")),
    "udf_05_packager": _packaged, "udf_06_table_store": _stored("table"), "udf_06_folder_store": _stored("folder"), "udf_07_transformer": _transformed,
    "src_16_book_sheets": _book_sheet,
}
_CORE_ROWS = (
    ("core_media", "Empty Mediaobject", "k1 + k4"), ("core_figures", "Misclassified Figure", "k1"), ("core_rows", "Empty Element", "k3"), ("core_paragraphs", "Nested Para", "k2"), ("core_titles", "Missing Title", "k3"),
    ("core_models", "Invalid Content Model", "CAST(k0 + k1 + k2 + k3 + k6 > 0 AS INTEGER)"), ("core_attributes", "Missing Attribute", "k3"), ("core_foreign", "Invalid Element", "3 * k6"),
)
_ERRORS = "1 + 2 * a"
ORACLE_SQL = {
    "fix_02_formal": _sums(6, ("fix_02_formal", "formal", "k0")), "fix_05_cals": _sums(6, ("fix_05_cals", "cals", "k1")), "fix_07_bridgeheads": _sums(6, ("fix_07_bridgeheads", "bridgehead", "k2")),
    "fix_08_media": _sums(6, ("fix_08_media", "empty media", "k3")), "fix_09_models": _sums(6, ("fix_09_models", "content", "k1 + k4")), "fix_14_space": _sums(6, ("fix_14_space", "space", "k5"), ("fix_14_space", "empty figure", "k5")),
    "fix_16_core": _sums(7, *_CORE_ROWS),
    "fix_17_targeted": _sums(7, ("target_images", "wrapped image", "k0"), ("target_media", "empty media", "k4"), ("target_texts", "phrase", "k1"), ("target_tables", "table title", "k3"), ("target_tables", "cols", "k3"), ("target_sections", "title first", "k5")),
    "val_01_dtd": f"WITH {_LINES}, e AS (SELECT 'Text Not Allowed' AS error_type, count(*) AS n FROM g UNION ALL SELECT 'Undeclared Element', CAST(sum(3 * a) AS BIGINT) FROM g UNION ALL SELECT 'Invalid Content Model', CAST(sum(r) AS BIGINT) FROM g UNION ALL SELECT 'Missing Attribute', CAST(sum(a) AS BIGINT) FROM g UNION ALL SELECT 'Broken Link', CAST(sum(a) AS BIGINT) FROM g) SELECT * FROM e WHERE n > 0",
    "val_01_after_fixes": f"WITH {_LINES}, t AS (SELECT g.*, {_LATE} AS o FROM g) SELECT count(*) AS chapters, CAST(sum({' + '.join(n for *_, n in _CHAIN_COUNTS)}) AS BIGINT) AS fixes, CAST(sum({_ERRORS}) AS BIGINT) AS before, CAST(0 AS BIGINT) AS after FROM t",
    "udf_02_chain": f"WITH {_LINES} SELECT 'Broken Link' AS error_type, CAST(sum(a) AS BIGINT) AS n FROM g HAVING sum(a) > 0",
    "udf_03_validator": f"WITH {_LINES} SELECT false AS is_valid, count(*) AS chapters, CAST(sum({_ERRORS}) AS BIGINT) AS errors, CAST(sum(a) AS BIGINT) AS links FROM g",
    "udf_04_fixer": f"WITH {_counted(7)}, p AS (SELECT chapter, unnest([" + ", ".join(f"{{'kind': '{kind}', 'n': {expr}}}" for _, kind, expr in _CORE_ROWS) + "]) AS x FROM g) SELECT chapter, CAST(sum(x.n) AS INTEGER) AS fixes, CAST(count(DISTINCT x.kind) FILTER (x.n > 0) AS INTEGER) AS kinds FROM p GROUP BY 1",
    "udf_05_packager": "SELECT n_regionkey AS book, CAST(count(*) + 1 AS INTEGER) AS n_files, coalesce(string_agg(concat(lower(n_name), '.png'), ',' ORDER BY lower(n_name)) FILTER (n_nationkey % 2 = 0), '') AS media FROM nation GROUP BY 1",
    "udf_06_table_store": "SELECT concat('97800', n_regionkey) AS isbn, count(*) AS files, CAST(sum(CASE WHEN n_regionkey = 2 THEN 3 ELSE strlen(n_name) END) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS kinds FROM nation WHERE n_regionkey <> 3 GROUP BY 1",
    "udf_06_folder_store": "SELECT concat('97800', n_regionkey) AS isbn, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1",
    "udf_07_transformer": f"WITH {_LINES} SELECT 'tags,media' AS steps, a = 0 AS is_valid, count(*) AS chapters, CAST(sum(a) AS BIGINT) AS errors FROM g GROUP BY 2",
    "src_16_book_sheets": "SELECT CAST(r_regionkey AS INTEGER) AS region, concat('978', r_regionkey) AS isbn, r_name AS title, 'Ann|Bob' AS authors, '2001' AS year FROM region",
}
