"""The library's own validator, fixers and packager on the extension points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markup as M
from ..operators import markup_variants as V
from . import extension as X
from . import writers as K


class RuleValidator(X.Validator):
    """The rules of ``markup.violations``."""

    def errors(self, chapters: DataFrame, key: str = "chapter") -> DataFrame:
        return M.chapter_violations(chapters, key)

    def validate(self, chapters: DataFrame, key: str = "chapter") -> DataFrame:
        return M.chapter_verdicts(chapters, key)


class ChainFixer(X.Fixer):
    """A chain of rewrites: ``full``, ``core`` or ``targeted``."""

    CHAINS = {"full": M.CHAIN, "core": V.CORE, "targeted": V.TARGETED}

    def __init__(self, chain: str = "full"):
        self.rewrites = self.CHAINS[chain]
        self.categories = tuple(self.rewrites)

    def fix(self, chapters: DataFrame, key: str = "chapter") -> DataFrame:
        return M.rewrite(chapters, key, rewrites=self.rewrites)


class BookPackager(X.Packager):
    """One ZIP for each book: its chapters and contents, and the supported media that belong to it."""

    def split(self, books: DataFrame, key: str = "book") -> DataFrame:
        return M.split_chapters(books, key)

    def package(self, books: DataFrame, media: DataFrame | None = None, key: str = "book") -> DataFrame:
        made = K.book_packages(self.split(books, key))
        if media is None:
            return made
        names = self.supported(media).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("media"))
        return made.join(names, key, "left").withColumn("media", F.coalesce("media", F.array().cast("array<string>")))
