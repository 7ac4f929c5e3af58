"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names, and plain re-implementations."""

from __future__ import annotations

import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, pii string, n_words string, __text string"
LONG = " ".join(f"w{i % 997} the of and to" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and the cat sat on the mat near the old red barn door today"),
    (2, "The quick brown fox jumps over the lazy dog and the cat sat on the mat near the old red barn door today"),
    (2, "The quick brown fox jumps over the lazy dog and the cat sat on the mat near the old red barn door today"),
    (3, "The quick brown fox jumps over the lazy dog and the cat sat on the mat near the old red barn door tonight"),
    (4, None), (5, ""), (6, " \t\n"), (None, "a row without an id"), (None, None), (7, LONG), (8, "one"), (9, "two words"),
    (10, "Mail a.b@c-d.org or a@b.c-d_x@e.f now; call +1 (222) 333-4444; ip 10.0.0.255 and 256.1.1.1; card 4111-1111-1111-1111 x 4111111111111112"),
    (11, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. MIT license!\nGNU General Public License"),
    (12, "ÄÖÜ straße naïve œuvre 中文 😀 é é   don't we'll I'VE 12345 ½²  double  spaces\t\ttabs\r\n"),
    (13, "same line\nsame line\nsame line\nother # $ % & | < > *\n\n"), (14, "x" * 70000), (15, "1 2 3 " * 4000), (16, "a a a a a a a a a a a a a a"),
]


def documents(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "x", "y", "z", "w", "v") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def quality_counts(t: str) -> tuple:
    w = words(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t: str) -> list[tuple[int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((m.start(), rank, m.end()))
    return [(a, b, list(PII)[k]) for a, k, b in sorted(out)]


PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def base_licenses(t: str) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    found = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))
