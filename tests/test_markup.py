"""Rewrites, checks and conversions of markup on small texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.operators import markup as M


def fixed(xml, *names):
    return M.fixed(xml, list(names))[0]


@pytest.mark.parametrize("name, xml, want", [
    ("fix_01_titles", '<chapter id="a"><para/></chapter>', '<chapter id="a"><title>a</title><para /></chapter>'),
    ("fix_02_formal", "<c><informaltable><title>T</title></informaltable><informalfigure/></c>", "<c><table><title>T</title></table><informalfigure /></c>"),
    ("fix_03_figures", "<figure><imagedata/><title>T</title></figure>", "<figure><title>T</title><mediaobject><imageobject><imagedata /></imageobject></mediaobject></figure>"),
    ("fix_04_levels", "<c><section><section/></section></c>", "<c><sect1><sect2 /></sect1></c>"),
    ("fix_05_cals", "<table><tr><td>a</td><td>b</td></tr></table>", '<table><tgroup cols="2"><tbody><row><entry>a</entry><entry>b</entry></row></tbody></tgroup></table>'),
    ("fix_06_paragraphs", "<para>a<para>b<i/></para>c</para>", "<para>ab<i />c</para>"),
    ("fix_07_bridgeheads", "<c><para/><bridgehead>H</bridgehead><para/></c>", "<c><para /><sect1><title>H</title><para /></sect1></c>"),
    ("fix_08_media", "<c><mediaobject><imageobject/></mediaobject>t</c>", "<c>t</c>"),
    ("fix_09_models", "<c><itemizedlist><para>x</para></itemizedlist></c>", "<c><itemizedlist><listitem><para>x</para></listitem></itemizedlist></c>"),
    ("fix_09_order", "<c><sect1/><para/></c>", "<c><para /><sect1 /></c>"),
    ("fix_10_empty", "<c><para> </para><title/>x</c>", "<c><title />x</c>"),
    ("fix_11_attributes", "<tgroup><tbody><row><entry/><entry/></row></tbody></tgroup>", '<tgroup cols="2"><tbody><row><entry /><entry /></row></tbody></tgroup>'),
    ("fix_12_ids", "<chapter><sect1/><sect1/></chapter>", '<chapter id="ch0001"><sect1 id="ch0001s0001" /><sect1 id="ch0001s0002" /></chapter>'),
    ("fix_13_excluded", "<c>a<div>b<b>c</b></div>d<br/>e</c>", '<c>ab<emphasis role="bold">c</emphasis>de</c>'),
    ("fix_14_space", "<c><title> a \n b </title></c>", "<c><title>a b</title></c>"),
    ("fix_15_links", '<c id="k"><link linkend="gone">t</link><link linkend="k">u</link></c>', '<c id="k">t<link linkend="k">u</link></c>'),
    ("fix_15_sections", "<sect1><sect1/></sect1>", "<sect1><sect2 /></sect1>"),
])
def test_rewrites(name, xml, want):
    assert fixed(xml, name) == want


def test_odd_texts():
    assert M.fixed("<a", ["fix_01_titles"]) == ("<a", [("parse", "malformed", "")])
    assert M.fixed(None, ["fix_01_titles"])[1][0][0] == "parse"
    assert fixed('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;&amp;</a>', "fix_14_space") == "<a>&amp;x;&amp;</a>"
    assert M.nodes_of("") == [] and [n["path"] for n in M.nodes_of("<a><b/><b/></a>")] == ["/a[1]", "/a[1]/b[1]", "/a[1]/b[2]"]


def test_the_chain_leaves_nothing_to_fix():
    xml = "<chapter><section><p>x<br/></p></section><table><tr><td>1</td></tr></table><link linkend='n'>t</link></chapter>"
    once = fixed(xml, *M.CHAIN)
    again, log = M.fixed(once, list(M.CHAIN))
    assert again == once and log == []


def test_violations(spark):
    xml = "<chapter><tgroup><row><para/></row></tgroup><imagedata/><xref linkend='page_1'/></chapter>"
    nodes = M.node_table(spark.createDataFrame([(1, xml)], "chapter int, xml string"))
    kinds = sorted((r["error_type"], r["error_description"]) for r in M.violations(nodes).collect())
    assert kinds == sorted([("Broken Link", "page_1"), ("Invalid Content Model", "chapter has no title"), ("Invalid Element", "row holds para"), ("Invalid Element", "tgroup holds row"), ("Missing Attribute", "imagedata lacks fileref"), ("Missing Attribute", "tgroup lacks cols")])
    assert [r["is_page"] for r in M.broken_links(nodes).collect()] == [True]


def test_markdown():
    text = "# A\n\nsome *it* text\n\n## B\n\n- x\n- y\n\n1. n\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n![cap](f.png)\n\n```\na < b\n```\n# C\n"
    out = M.markdown_markup(text)
    tags = [n["tag"] for n in M.nodes_of(out)]
    assert tags.count("sect1") == 2 and tags.count("sect2") == 1 and tags.count("listitem") == 3 and tags.count("entry") == 4 and tags.count("figure") == 1 and "programlisting" in tags and "emphasis" in tags
    assert M.markdown_markup(None) == "<chapter></chapter>"


def test_tables_and_images():
    cells = M.table_cells_of("<table><tr><th colspan=2>h</th></tr><tr><td>a &amp; <b>b</b></td><td><table><tr><td>in</td></tr></table></td></table>")
    assert [(c["table_id"], c["row"], c["text"]) for c in cells] == [(0, 0, "h"), (0, 1, "a & b"), (0, 1, ""), (1, 0, "in")]
    assert M.table_cells_of(None) == [] and 'cols="2"' in M.table_markup(cells[:2])
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (5).to_bytes(4) + (7).to_bytes(4)
    assert M.image_facts(png) == (5, 7, "PNG") and M.image_facts(b"GIF89a" + b"\x03\0\x04\0") == (3, 4, "GIF") and M.image_facts(None) == (0, 0, "")
    assert M.image_facts(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x09\x00\x08\x03") == (8, 9, "JPEG")


def test_dangling_targets_are_those_of_the_node_table(spark):
    texts = [
        "<c><link linkend='a'>x</link><xref linkend=\"b\"/><para id='a'/><!-- <para id='b'/> --></c>", "<c><link>t</link><link linkend=''/></c>", "<c id='c'><link url='a>b' linkend='c'>x</link><linked linkend='z'/></c>",
        "<!DOCTYPE c [<!ENTITY x 'y'>]><c><xref linkend='q'/>&x;</c>", "<c><p title='id=1' id = 'k'/><link linkend='k'/><link linkend='1'/></c>", "<c/>",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "chapter int, xml string")
    by_nodes = {i: [] for i in range(len(texts))}
    for r in M.broken_links(M.node_table(df)).collect():
        by_nodes[r["chapter"]].append(r["target"] or None)
    made = {r["chapter"]: r["t"] for r in df.select("chapter", M.dangling_targets(F.col("xml")).alias("t")).collect()}
    assert {i: sorted(t, key=str) for i, t in made.items()} == {i: sorted(t, key=str) for i, t in by_nodes.items()}
