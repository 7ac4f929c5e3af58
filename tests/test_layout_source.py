"""Layout XML that the query writes and reads again, against a plain version."""

from __future__ import annotations

from pageloom.plans import documents

TEXTS = [(1, "a\nbb\n\nccc"), (19, "x"), (20, "y\nzz"), (1020, "a\n" * 9), (5_000_000_000, "far"), (7, "line\n" * 8100), (8, "one"), (None, "no id"), (30, None), (31, "")]


def plain(rows) -> list:
    out = []
    for i, text in rows:
        for k, line in enumerate([] if text is None else text.split("\n")):
            n = len(line)
            top = k % 8 * 12 + n % 3
            out.append((i, k // 8, f"t{k}", float(top), float(10 * (n % 7)), float(top + 10 + n % 5)))
    return sorted(out, key=str)


def test_fragments_of_all_documents(spark, tmp_path):
    for name, rows in (("some", TEXTS), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        made = documents.QUERIES["src_12_layout"](spark, f"{tmp_path}/{name}").select("doc_id", "page", "text", "top", "left", "baseline")
        assert sorted((tuple(r) for r in made.collect()), key=str) == plain(rows)
