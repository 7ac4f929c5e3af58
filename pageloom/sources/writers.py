"""Sinks: layout sheets, catalogues, reports and packages. A package is built inside its own row."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import detection as D
from ..operators import tracking as T
from ..shipping import ship


def tracker_sheet(df: DataFrame, keys: tuple[str, str] = ("filename", "created_at")) -> DataFrame:
    """Tracker rows, the latest for each file and start time."""
    keyed = df.withColumn("__k", F.concat_ws("|", keys[0], F.col(keys[1]).cast("string")))
    return T.upsert_latest(keyed, "__k", [F.col("progress")]).drop("__k")


def layout_sheets(frags: DataFrame) -> dict[str, DataFrame]:
    """Reading order, lines, images and debug sheets of a page layout."""
    ordered = frags.select("doc_id", "page", "block", "col_id", "baseline", "left", "text")
    lines = D.line_pivot(frags.withColumn("line", F.concat_ws("-", "doc_id", "page", "baseline")), ["line"], "left")
    return {"ReadingOrder": ordered, "Lines": lines, "Images": frags.filter("text = ''").select("doc_id", "page", "left", "top"), "Debug": frags}


def image_catalogue(images: DataFrame) -> DataFrame:
    """The manifest: one row for each image."""
    return images.select("filename", "original_name", "chapter", "figure_number", "caption", "alt_text", "width", "height", "size", "format")


def validation_sheets(errors: DataFrame) -> dict[str, DataFrame]:
    return {"Errors": errors, "Summary": T.error_counts(errors)}


def complexity_json(report: DataFrame) -> DataFrame:
    return report.select("doc_id", F.to_json(F.struct(*(c for c in report.columns if c != "doc_id"))).alias("json"))


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Each sheet as CSV below the folder."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def write_catalogue(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", "images").option("rowTag", "image").save(f"{folder}/catalogue")
    df.write.mode("overwrite").option("header", "true").csv(f"{folder}/manifest")


def package_bytes(files: list[tuple[str, str]]) -> bytes:
    """A ZIP with fixed times, so equal content gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files:
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


def book_packages(chapters: DataFrame, key: str = "book") -> DataFrame:
    """``(key, package, n_files)``: a book file with entity declarations and one file for each chapter."""
    ship(chapters.sparkSession)
    parts = F.array_sort(F.collect_list(F.struct("n", "entity", "filename", "xml")))
    books = chapters.groupBy(key).agg(parts.alias("parts"))

    def run(batches):
        for b in batches:
            made = []
            for files in b.column(1).to_pylist():
                declared = "".join(f'<!ENTITY {p["entity"]} SYSTEM "{p["filename"]}">\n' for p in files)
                book = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE book [\n{declared}]>\n<book>' + "".join(f"&{p['entity']};" for p in files) + "</book>"
                made.append(package_bytes([("Book.XML", book), *((p["filename"], p["xml"]) for p in files)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), pa.array([len(f) + 1 for f in b.column(1)], pa.int32())], names=[key, "package", "n_files"])

    return books.mapInArrow(run, f"`{key}` {books.schema[key].dataType.simpleString()}, package binary, n_files int")


def media_names(used: DataFrame, fetched: DataFrame) -> DataFrame:
    """Sequential names of the fetched images of each chapter; those that were not fetched get none and no number."""
    have = used.join(fetched.select("file").distinct(), "file")
    n = F.row_number().over(W.Window.partitionBy("chapter").orderBy("place"))
    named = have.withColumn("name", F.concat("chapter", F.lit("f"), F.lpad(n.cast("string"), 2, "0"), F.lit("."), F.regexp_extract("file", r"\.([^.]+)$", 1)))
    return used.join(named.select("chapter", "place", "name"), ["chapter", "place"], "left")
