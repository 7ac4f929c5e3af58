"""Pages without an article element, class names that only look like boilerplate, and broken markup of any length."""

from __future__ import annotations

import html as H
import re
import time

import pytest

from pageloom.llm import html

WORDS = "the report of the plan was read and sent by them when we met in the old house on the hill near the sea."
KEYS = "Lisbon Porto Faro Braga Coimbra Aveiro Leiria Evora Setubal Viseu Guarda Beja Bragança Sintra Cascais Tavira Lagos"


@pytest.mark.parametrize("page, text", [
    (f"<body><div class='layout has-sidebar'><p>{WORDS}</p></div>", WORDS),
    (f"<body><div id='content-no-nav'><p>{WORDS}</p></div>", WORDS),
    (f"<body><div class='wrap withoutNav no-menu'><p>{WORDS}</p></div>", WORDS),
    (f"<body><div class='entry-header'><h1>Head</h1></div><div><p>{WORDS}</p></div>", f"Head {WORDS}"),
    (f"<body><div class='post'><header><h1>Head</h1></header><p>{WORDS}</p></div>", f"Head {WORDS}"),
    (f"<body><header><h1>Site</h1></header><div class='post'><p>{WORDS}</p></div>", WORDS),
    (f"<body><div class='widget-area'><h2>Head</h2><p>{WORDS}</p><p>{WORDS}</p></div><div class='footer'>All rights reserved</div>", f"Head {WORDS} {WORDS}"),
    (f"<body><div class='siteFooter'><p>{WORDS}</p></div><div class='mainNav'>{WORDS}</div><div><p>{WORDS}</p></div>", WORDS),
    (f"<body><div><p>{WORDS}</p></div><div class='comments-area'><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div>", WORDS),
    (f"<body><div><p>{WORDS}</p><p>{WORDS}</p></div><div><p>{KEYS}</p></div>", f"{WORDS} {WORDS}"),
    (f"<body><div><p>{WORDS}</p><p><a href=x>{WORDS}</a></p></div>", WORDS),
    ("<body><div><p>Only a short one.</p></div>", "Only a short one."),
    (f"<body><div class='cookie-bar'><p>{WORDS}</p></div><div><p>Only a short one.</p></div>", "Only a short one."),
])
def test_names_and_density(page, text):
    assert html.main_text(page) == text


def test_density_finds_the_article_of_the_drivers_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    same = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)
        want = re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", inner[1]))).strip()
        assert html.main_text(r["html"]) == want
        same += html.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) == want
    assert same >= 0.97 * len(rows)


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<div>" + "</b>" * n, lambda n: "<div>" + "<b>" * n + "<p>x" * n,
    lambda n: "<div class='nav'>" * n + "x", lambda n: "<a href=x>" * n + "</p>" * n, lambda n: "<i>x" * n + "</i>" * n, lambda n: "<p>x</p>" * n,
])
def test_cost_is_linear_in_broken_markup(make):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html.main_text(make(n))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
