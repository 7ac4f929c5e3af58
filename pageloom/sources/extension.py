"""Extension points: adapters, validators, fixers, packagers and transformers run as one chain of DataFrame steps."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Chain:
    """Named steps by kind, applied in the order adapter, transformer, fixer, validator, packager; hooks see each result."""

    steps: dict[str, list[tuple[str, Step]]] = field(default_factory=lambda: {k: [] for k in Chain.KINDS})
    hooks: list[Callable[[str, DataFrame], DataFrame | None]] = field(default_factory=list)
    KINDS = ("adapter", "transformer", "fixer", "validator", "packager")

    def register(self, kind: str, name: str, step: Step) -> Chain:
        if kind not in self.KINDS:
            raise ValueError(f"kind must be one of {self.KINDS}")
        self.steps[kind].append((name, step))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for kind in self.KINDS:
            for name, step in self.steps[kind]:
                df = df.transform(step)
                for hook in self.hooks:
                    df = hook(name, df) or df
        return df


class Validator(ABC):
    """Chapters ``(key, xml)`` to error rows ``(key, path, error_type, error_description, severity)``."""

    schema_type = "chapter"

    @abstractmethod
    def errors(self, chapters: DataFrame, key: str = "chapter") -> DataFrame: ...

    def validate(self, chapters: DataFrame, key: str = "chapter") -> DataFrame:
        """One row for each chapter: whether it is valid, and its errors by type; both sides grow with the corpus, so neither is broadcast."""
        found = self.errors(chapters, key).groupBy(key, "error_type").agg(F.count(F.lit(1)).alias("n"))
        by_type = found.groupBy(key).agg(F.sum("n").cast("bigint").alias("n_errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("by_type"))
        joined = chapters.select(key).join(by_type.hint("merge"), key, "left")
        return joined.select(key, F.col("n_errors").isNull().alias("is_valid"), F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"), "by_type")

    def validate_string(self, spark: SparkSession, xml: str, context: str = "string") -> DataFrame:
        return self.errors(spark.createDataFrame([(context, xml)], "chapter string, xml string"))


class Fixer(ABC):
    """Chapters ``(key, xml)`` to ``(key, xml, fixes)``, the new text with its log."""

    schema_type = "chapter"
    categories: tuple[str, ...] = ()

    @abstractmethod
    def fix(self, chapters: DataFrame, key: str = "chapter") -> DataFrame: ...

    def fix_and_validate(self, chapters: DataFrame, validator: Validator, key: str = "chapter") -> DataFrame:
        """One row for each chapter: fixes made, and errors before and after."""
        fixed = self.fix(chapters, key)
        before = validator.validate(chapters, key).select(key, F.col("n_errors").alias("before"))
        after = validator.validate(fixed.select(key, "xml"), key).select(key, F.col("n_errors").alias("after"))
        return fixed.select(key, F.size("fixes").cast("bigint").alias("n_fixes")).join(before.hint("merge"), key).join(after.hint("merge"), key)


class Packager(ABC):
    """Books ``(key, xml)`` to one package each; ``media`` of (key, name, content) is joined, not fetched one by one."""

    package_format = "zip"
    media_types: tuple[str, ...] = ("png", "jpg", "jpeg", "gif", "svg")

    @abstractmethod
    def split(self, books: DataFrame, key: str = "book") -> DataFrame: ...

    @abstractmethod
    def package(self, books: DataFrame, media: DataFrame | None = None, key: str = "book") -> DataFrame: ...

    def supported(self, media: DataFrame, name: str = "name") -> DataFrame:
        return media.filter(F.lower(F.substring_index(name, ".", -1)).isin(*self.media_types))


class Transformer:
    """Named steps on the text of a chapter, applied in the order in which they were loaded."""

    def __init__(self):
        self.steps: list[tuple[str, Step]] = []

    def load(self, step: Step, name: str) -> Transformer:
        self.steps.append((name, step))
        return self

    def clear(self) -> Transformer:
        self.steps.clear()
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        return df

    def transform_and_validate(self, df: DataFrame, validator: Validator, key: str = "chapter") -> DataFrame:
        return validator.validate(self.transform(df), key)


class OutlineSource(DataSource):
    """``spark.read.format("outline").option("text", ...)``: rows (seq, level, title, page) of an indented outline."""

    @classmethod
    def name(cls) -> str:
        return "outline"

    def schema(self) -> str:
        return "seq int, level int, title string, page int"

    def reader(self, schema) -> DataSourceReader:
        return _OutlineReader(self.options.get("text", ""))


class _OutlineReader(DataSourceReader):
    def __init__(self, text: str):
        self.text = text

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for k, line in enumerate(x for x in self.text.split("\n") if x.strip()):
            title, _, page = line.strip().rpartition(" ")
            yield k, (len(line) - len(line.lstrip())) // 2 + 1, title or page, int(page) if page.isdigit() else None


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(OutlineSource)
