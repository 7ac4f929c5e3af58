"""Main text of pages: the driver's pages against their article element, and made pages of many shapes."""

from __future__ import annotations

import html as H
import re

import pytest

from pageloom.llm import html

WORDS = "the report of the plan was read and sent by them when we met in the old house on the hill near the sea"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""),
    (f"<html><head><title>T</title></head><body><p>{WORDS}</p></body></html>", WORDS),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{WORDS}</p><p>Short.</p></article><footer>&copy; x</footer>", f"A & B {WORDS} Short."),
    (f"<body><div class='sidebar'><p>{WORDS}</p></div><main><p>{WORDS}<br>and on</p></main>", f"{WORDS} and on"),
    (f"<body><header>Top</header><article><header><h1>Title</h1></header><p>{WORDS}</p><div class='ad'>{WORDS}</div><p>End.</p></article>", f"Title {WORDS} End."),
    (f"<article><p>{WORDS}</p><section id='comments'><p>{WORDS}</p></section></article>", WORDS),
    (f"<article><p>{WORDS}</p><form><p>{WORDS}</p><input name=a><button>Go</button></form></article>", WORDS),
    (f"<article><script>var t='</p><p>{WORDS}';</script><style>p{{}}</style><p>{WORDS}&nbsp;&#65;&#x42;&copy;</p><!-- <p>no</p> --></article>", f"{WORDS} AB©"),
    (f"<article><p>{WORDS}<p>Second <b>bold</b> one.<p>Third", f"{WORDS} Second bold one. Third"),
    (f"<body><div class='cookie-notice'>{WORDS}</div><div><p>{WORDS}</p><p>Tail bit.</p></div><div id='footer'><p>{WORDS}</p></div>", f"{WORDS} Tail bit."),
    (f"<article><p>{WORDS} &am", f"{WORDS} &am"),
    ("<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", ""),
])
def test_shapes(page, text):
    assert html.main_text(page) == text


def test_driver_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    for r in html.extract(df).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r["page_id"]], re.S)
        want = re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", inner[1]))).strip() if inner else ""
        assert r["text"] == want


def test_rows_stay(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, f"<p>{WORDS}</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in html.extract(df).collect()), key=str) == sorted([(1, "u", ""), (1, "u", ""), (None, None, WORDS)], key=str)
    assert html.extract(df.limit(0)).count() == 0


def test_a_very_long_page():
    assert html.main_text("<article>" + f"<p>{WORDS}</p>" * 3000) == " ".join([WORDS] * 3000)
    assert html.main_text("<" * 50000) == html.main_text("<" * 50000)
