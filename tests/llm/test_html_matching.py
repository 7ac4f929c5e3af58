"""Attributes by name, text beside article cards, and languages without listed stop words."""

from __future__ import annotations

import pytest

from pageloom.llm import html

WORDS = "the report of the plan was read and sent by them when we met in the old house on the hill near the sea"
RUSSIAN = "Вчера вечером жители старого города собрались возле реки, чтобы обсудить новый мост, который строят уже третий год подряд."
CHINESE = "昨天晚上老城区的居民聚集在河边讨论已经建造了三年的新桥梁工程问题。" * 3
CARD = "<article><h3>Teaser</h3><p>A short teaser.</p></article>"


@pytest.mark.parametrize("page, text", [
    (f"<body style='overflow-x:hidden'><p>{WORDS}</p>", WORDS),
    (f'<body><div title="a hidden valley, class=ad"><p>{WORDS}</p></div>', WORDS),
    (f"<body><div class='overflow-hidden'><p>{WORDS}</p></div>", WORDS),
    (f"<body><div class='overflow-x-hidden wide'><p>{WORDS}</p></div>", WORDS),
    (f"<body><div data-hidden='no' data-role='search'><p>{WORDS}</p></div>", WORDS),
    (f"<body><p>{WORDS}</p><div hidden><p>{WORDS}</p></div><div class=hidden><p>{WORDS}</p></div><div aria-hidden = true><p>{WORDS}</p></div>", WORDS),
    (f"<body><p>{RUSSIAN}</p>", RUSSIAN),
    (f"<body><div><p>{CHINESE}</p></div>", CHINESE),
    (f"<body><p>{RUSSIAN}</p><ul><li><a href=x>{RUSSIAN}</a></li></ul>", RUSSIAN),
])
def test_matching(page, text):
    assert html.main_text(page) == text


def test_article_cards_do_not_veto_the_body():
    assert f"{WORDS} {WORDS}" in html.main_text(f"<body><div><p>{WORDS}</p><p>{WORDS}</p></div><div>{CARD}{CARD}</div>")
    assert html.main_text(f"<body><div><p>{WORDS}</p></div><article><p>{WORDS}</p><p>{WORDS} again</p></article>") == f"{WORDS} {WORDS} again"
