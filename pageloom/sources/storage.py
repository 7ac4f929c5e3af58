"""Stores of files by ISBN, on any file system that Spark reaches: one folder of rows, or the files themselves.

Both are read as a table ``(isbn, filename, content, length, file_type,
uploaded_at)``. Puts add to a store, and the latest row of an ISBN and a
name counts; deletes are rows too, so nothing is rewritten.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S

COLUMNS = "isbn string, filename string, content binary, length bigint, file_type string, uploaded_at timestamp"


class Storage(ABC):
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def connected(self) -> bool:
        """Whether the store can be read."""
        return self.files().limit(1).count() >= 0

    @abstractmethod
    def put(self, rows: DataFrame) -> None:
        """Add files: rows of ``isbn, filename, content``."""

    @abstractmethod
    def files(self) -> DataFrame:
        """All files that are there."""

    @abstractmethod
    def delete(self, isbn: str, filename: str | None = None) -> None:
        """Take a file, or all files of an ISBN, out."""

    def listing(self, isbn: str, file_types: list[str] | None = None) -> DataFrame:
        own = self.files().filter(F.col("isbn") == isbn)
        return (own.filter(F.col("file_type").isin(*file_types)) if file_types else own).drop("content")

    def get(self, isbn: str, filename: str) -> bytes | None:
        """One file's content; the one call that brings content to the driver."""
        row = self.files().filter((F.col("isbn") == isbn) & (F.col("filename") == filename)).select("content").first()
        return None if row is None else bytes(row[0])

    def exists(self, isbn: str, filename: str) -> bool:
        return not self.files().filter((F.col("isbn") == isbn) & (F.col("filename") == filename)).isEmpty()

    def statistics(self) -> DataFrame:
        return self.files().groupBy("isbn").agg(F.count(F.lit(1)).alias("files"), F.sum("length").cast("bigint").alias("bytes"), F.count_distinct("file_type").alias("kinds"))

    @staticmethod
    def described(rows: DataFrame) -> DataFrame:
        name = F.col("filename")
        return rows.select(F.col("isbn").cast("string").alias("isbn"), "filename", "content", F.octet_length("content").cast("bigint").alias("length"), S.file_type(name).alias("file_type"), *(["uploaded_at"] if "uploaded_at" in rows.columns else []))


class TableStorage(Storage):
    """Rows below one folder."""

    def put(self, rows: DataFrame) -> None:
        self.described(rows).withColumn("uploaded_at", F.current_timestamp()).withColumn("gone", F.lit(False)).write.mode("append").parquet(self.folder)

    def delete(self, isbn: str, filename: str | None = None) -> None:
        own = self.files().filter(F.col("isbn") == isbn)
        gone = own.filter(F.col("filename") == filename) if filename else own
        marks = gone.withColumn("content", F.lit(None).cast("binary")).withColumn("uploaded_at", F.current_timestamp()).withColumn("gone", F.lit(True))
        marks.write.mode("append").parquet(self.folder)

    def files(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(COLUMNS + ", gone boolean").parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COLUMNS)
        rest = [c for c in rows.columns if c not in ("isbn", "filename")]
        latest = rows.groupBy("isbn", "filename").agg(F.max_by(F.struct(*rest), F.struct("uploaded_at", "gone")).alias("r"))
        return latest.filter("NOT r.gone").select("isbn", "filename", *(f"r.{c}" for c in rest if c != "gone"))


class FolderStorage(Storage):
    """One folder of plain files for each ISBN, read in place. Puts and deletes are left to what fills the folders."""

    def put(self, rows: DataFrame) -> None:
        raise NotImplementedError("files are placed by their producer")

    def delete(self, isbn: str, filename: str | None = None) -> None:
        raise NotImplementedError("files are removed by their producer")

    def files(self) -> DataFrame:
        read = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        parts = F.split("path", "/")
        named = read.select(F.element_at(parts, -2).alias("isbn"), F.element_at(parts, -1).alias("filename"), "content", F.col("modificationTime").alias("uploaded_at"))
        return self.described(named)


BACKENDS = {"table": TableStorage, "folder": FolderStorage}


def storage(spark: SparkSession, kind: str, folder: str) -> Storage:
    """A store by the name of its kind."""
    if kind not in BACKENDS:
        raise ValueError(f"kind must be one of {sorted(BACKENDS)}")
    return BACKENDS[kind](spark, folder)
