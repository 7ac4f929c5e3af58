"""Models of a document type on declarations and chapters worked out by hand."""

from __future__ import annotations

import re

import pytest

from pageloom.operators import dtd
from pageloom.operators import markup as M

DTD = """
<!-- <!ELEMENT no EMPTY> -->
<!ENTITY % inline "emphasis | link">
<!ENTITY % text "#PCDATA | %inline;">
<!ENTITY % extra "IGNORE">
<!ELEMENT chapter (title, (para | list | image)*, sect1*)>
<!ELEMENT sect1 (title, para+)>
<!ELEMENT title (#PCDATA)>
<!ELEMENT para (%text;)*>
<!ELEMENT (emphasis | note) (#PCDATA)>
<!ELEMENT link (#PCDATA)>
<!ELEMENT list (item+)>
<!ELEMENT item (para+)>
<!ELEMENT image EMPTY>
<!ELEMENT box ANY>
<![%extra;[ <!ELEMENT hidden EMPTY> ]]>
<![INCLUDE[ <!ELEMENT shown EMPTY> ]]>
<!ATTLIST link linkend IDREF #REQUIRED role CDATA #IMPLIED>
<!ATTLIST image fileref CDATA #REQUIRED format (png | jpg) "png" alt CDATA #REQUIRED>
<!ENTITY % text "ignored, declared before">
"""


def test_declarations():
    made = {name: (pattern, mixed, required) for name, pattern, mixed, required in dtd.declarations(DTD)}
    assert set(made) == set("chapter sect1 title para emphasis note link list item image box shown".split())
    assert made["link"][1:] == (True, ["linkend"]) and made["image"] == ("", False, ["alt", "fileref"]) and made["box"][1]
    fits = lambda name, kids: re.fullmatch(made[name][0], "".join(k + "," for k in kids.split())) is not None
    assert fits("chapter", "title para image para sect1 sect1") and not fits("chapter", "para title") and not fits("chapter", "title sect1 para")
    assert fits("para", "") and fits("para", "link emphasis link") and not fits("para", "para") and fits("box", "a b") and not fits("list", "")


@pytest.mark.parametrize("xml, want", [
    ("<chapter><title>T</title><para>x <emphasis>y</emphasis> z</para></chapter>", []),
    ("<chapter><para>x</para></chapter>", ["Invalid Content Model"]),
    ("<chapter><title/>loose<list><item><para/></item></list></chapter>", ["Text Not Allowed"]),
    ("<chapter><title/><image fileref='a'/><image fileref='a' alt='b'/></chapter>", ["Missing Attribute"]),
    ("<chapter><title/><div/></chapter>", ["Invalid Content Model", "Undeclared Element"]),
    ("<chapter><title/><para id='p'><link linkend='p'>a</link><link linkend='q'>b</link></para></chapter>", ["Broken Link"]),
    ("<chapter><title/><para><link>a</link></para><sect1><title/></sect1></chapter>", ["Invalid Content Model", "Missing Attribute"]),
])
def test_chapters(spark, xml, want):
    nodes = M.node_table(spark.createDataFrame([(1, xml), (None, xml)], "chapter int, xml string"))
    rows = dtd.dtd_errors(nodes, dtd.models(spark, DTD)).collect()
    for key in (1, None):
        assert sorted(r["error_type"] for r in rows if r["chapter"] == key) == want
