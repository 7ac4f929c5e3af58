"""Licence scans by a positional rare-token index, in DataFrame operations only.

The index is built on the driver from a fixed set of templates, short references
and whole licence texts: for each template the words of highest IDF in its
mandatory phrases, with their positions. A file's words are looked up in it; a
hit at place p of a word that a template holds at place q posts the start p - q for
that template. The postings of a template are then intersected: only a start that
all its rare words post goes on. It is compared word by word and counts if
the share of matching words reaches the threshold and every mandatory key phrase
stands where it must. As the rare words lie in those phrases, the intersection loses
no place. Everything happens inside a file's own row, so nothing is shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import ascii_lower, indexes, let, words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANCHORS, LEAST_SHARE = 3, 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: First and last word of each phrase that must match whole.
    mandatory: tuple[tuple[int, int], ...]
    base: bool = False


def template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    all_words = tuple(w for w in re.split(SEPARATORS, text.lower()) if w)
    spans = []
    for phrase in phrases or (text,):
        own = tuple(w for w in re.split(SEPARATORS, phrase.lower()) if w)
        at = next(i for i in range(len(all_words)) if all_words[i : i + len(own)] == own)
        spans.append((at, at + len(own)))
    return Template(label, all_words, tuple(spans), base)


# The texts of public licences and of their customary notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
TEMPLATES = (
    template("mit", "mit license", base=True),
    template("apache", "apache license", base=True),
    template("gpl", "general public license", base=True),
    template("agpl", "gnu affero general public license"),
    template("apache", "licensed under the apache license version 2 0", "apache license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template("bsl", "boost software license version 1 0", "boost software license"),
    template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    template("epl", "eclipse public license version 2 0", "eclipse public license"),
    template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    template("lgpl", "gnu lesser general public license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("apache", APACHE, "apache license", "required by applicable law"),
    template("bsd", BSD, "redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"),
    template("gpl", GPL, "under the terms of the gnu general public license", "free software foundation"),
    template("isc", ISC, "permission to use copy modify", "the author disclaims all warranties"),
    template("mit", MIT, "permission is hereby granted free of charge", "without warranty of any kind"),
    template("mpl", MPL, "mozilla public license"),
    template("unlicense", UNLICENSE, "free and unencumbered software"),
    template("zlib", ZLIB, "must not be misrepresented"),
)


def idf(templates=TEMPLATES) -> dict[str, float]:
    count = Counter(w for t in templates for w in set(t.words))
    return {w: math.log(len(templates) / n) for w, n in count.items()}


def anchors(t: Template, weight: dict[str, float], most: int = ANCHORS) -> list[tuple[str, int]]:
    """The places of the highest-IDF words in the template's mandatory phrases."""
    inside = sorted({i for a, b in t.mandatory for i in range(a, b)}, key=lambda i: (-weight[t.words[i]], i))
    return [(t.words[i], i) for i in inside[:most]]


def _postings(templates) -> tuple[dict[str, list[dict]], list[int]]:
    """Word -> places (template, at), and for each template how many words must agree on a start."""
    weight, out, need = idf(templates), {}, []
    for k, t in enumerate(templates):
        own = anchors(t, weight)
        need.append(len(own))
        for word, at in own:
            out.setdefault(word, []).append({"template": k, "at": at})
    return out, need


def _gate(templates) -> str:
    """A pattern that every text with a template's mandatory phrase matches: one of its rarest words."""
    weight = idf(templates)
    rare = {max(t.words[t.mandatory[0][0] : t.mandatory[0][1]], key=lambda w: (len(w) > 3, weight[w])) for t in templates}
    return "(?i)(?<![0-9a-z])(?:" + "|".join(sorted(rare)) + ")(?![0-9a-z])"


def _found(text: Column, templates) -> Column:
    """Array of (template, start, share) of all verified places, for a text that passed the gate."""
    postings, need = _postings(templates)
    index = F.from_json(F.lit(json.dumps(postings)), "map<string,array<struct<template:int,at:int>>>")
    needed = F.array(*(F.lit(n) for n in need))

    def proposals(w: Column) -> Column:
        def posted(i: Column) -> Column:
            return F.transform(F.try_element_at(index, F.get(w, i)), lambda p: F.struct(p["template"].alias("template"), (i - p["at"]).alias("start")))

        def intersected(p: Column) -> Column:
            """The first of as many equal entries as the template has rare words."""
            first = lambda x, i: ~F.coalesce(F.get(p, i - 1) == x, F.lit(False))
            whole = lambda x, i: F.coalesce(F.get(p, i + F.get(needed, x["template"]) - 1) == x, F.lit(False))
            return F.filter(p, lambda x, i: first(x, i) & whole(x, i))

        hits = F.filter(indexes(F.size(w)), lambda i: F.get(w, i).isin(*postings))
        return let(F.sort_array(F.flatten(F.transform(hits, posted))), intersected)

    rows = lambda make: F.array(*(F.array(*(F.lit(v) for v in make(t))) for t in templates))
    own_words, must = rows(lambda t: t.words), rows(lambda t: [any(a <= i < b for a, b in t.mandatory) for i in range(len(t.words))])
    least = F.array(*(F.lit(1.0 if t.base else LEAST_SHARE) for t in templates))

    def verified(w: Column, p: Column) -> Column:
        """Share of matching words, null if the place fails."""

        def same(i: Column, word: Column) -> Column:
            at = p["start"] + i
            return F.coalesce(F.when(at >= 0, F.get(w, at)) == word, F.lit(False))

        def judged(same_words: Column) -> Column:
            right = F.aggregate(same_words, F.lit(0), lambda a, x: a + x.cast("int"))
            share = right / F.size(same_words).cast("double")
            whole = F.forall(F.zip_with(same_words, F.get(must, p["template"]), lambda x, m: x | ~m), lambda x: x)
            return F.when(whole & (share >= F.get(least, p["template"])), share)

        return let(F.transform(F.get(own_words, p["template"]), lambda word, i: same(i, word)), judged)

    def places(w: Column) -> Column:
        checked = F.transform(proposals(w), lambda p: F.struct(p["template"].alias("template"), p["start"].alias("start"), verified(w, p).alias("share")))
        return F.filter(checked, lambda p: p["share"].isNotNull())

    return let(words(ascii_lower(text), SEPARATORS), places)


def licenses(df: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """``df`` with ``n_words, places, n_base, first_word, last_word, base_labels, labels, score``.

    ``places`` holds every verified (label, start, n_words, share, base). The
    score is the largest share, 1 for a base phrase, 0 without any place. A null
    or empty text has no words; repeated rows are scanned each; an empty table
    gives an empty result; columns of ``df`` named as a result are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    field = lambda values: F.array(*(F.lit(v) for v in values))
    label, length, base = field(t.label for t in templates), field(len(t.words) for t in templates), field(t.base for t in templates)
    none = F.array().cast("array<struct<label:string,start:int,n_words:int,share:double,base:boolean>>")

    def named(p: Column) -> Column:
        k = p["template"]
        return F.struct(F.get(label, k).alias("label"), p["start"].alias("start"), F.get(length, k).alias("n_words"), p["share"].alias("share"), F.get(base, k).alias("base"))

    scanned = df.withColumn("n_words", F.size(words(text, RAW_SEPARATORS)).cast("bigint")).withColumn(
        "places", F.when(text.rlike(_gate(templates)), F.transform(_found(text, templates), named)).otherwise(none)
    )
    own = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(own, lambda p: p["start"].cast("bigint"))
    return scanned.withColumns({
        "n_base": F.size(own).cast("bigint"), "first_word": F.array_min(starts), "last_word": F.array_max(starts), "base_labels": joined(own),
        "labels": joined(F.col("places")), "score": F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)),
    })


def oracle_sql(templates=TEMPLATES) -> str:
    """DuckDB SQL for the digest of ``licenses`` over ``documents``: every start of every template, without an index."""
    quoted = ", ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {sum(b - a for a, b in t.mandatory)}, {i}, '{w}', {str(any(a <= i < b for a, b in t.mandatory)).lower()})"
        for k, t in enumerate(templates) for i, w in enumerate(t.words)
    )
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH template_words(k, label, base, size, must, spot, word, needed) AS (VALUES {quoted}),
docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), placed AS (
  SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM docs
), starts AS (
  SELECT row_id, k, any_value(label) AS label, any_value(base) AS base, place - spot AS first_at, count(*) / any_value(size)::DOUBLE AS share,
         count(*) FILTER (WHERE needed) AS held, any_value(must) AS must
  FROM placed JOIN template_words USING (word) GROUP BY row_id, k, place - spot
), places AS (
  SELECT * FROM starts WHERE held = must AND share >= CASE WHEN base THEN 1.0 ELSE {LEAST_SHARE} END
), found AS (
  SELECT row_id, count(*) FILTER (WHERE base) AS n_base, min(first_at) FILTER (WHERE base) AS first_word, max(first_at) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM places GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (row_id)
"""
