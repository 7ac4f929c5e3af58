"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every document gets base counts inside its own row. Mergeable KLL quantile
sketches of the derived ratios are then aggregated per language and source (one
partial sketch for each task and group, so a hot source costs no more than any
other) and merged once more per language. Both give a fence below and one above
each ratio, which are joined back to the documents. A ratio that is the same in
nearly all good text (no symbols, nothing repeated) has no spread to take a fence
from; there an absolute bound stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .native import indexes, let, words

#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Judged ratios. Those that are zero in most good text have a least upper fence, below which nothing is wrong, and
#: a ceiling: rows beyond it are sketched as little as those that fail a base rule, as they say nothing of good text.
RATIOS = {"word_length": None, "plain_odds": None, "line_length": None, "symbol_ratio": (0.3, 0.8), "dup_line_ratio": (0.3, 0.6), "repeat_ratio": (0.15, 0.2)}
#: A fence lies so many times the distance from the median to the quartile on its side from the median.
SPREAD, OUTER = 10.0, 0.25
#: That distance is at least this share of the median, for groups of nearly equal texts, and at most so many times the language's.
LEAST_SPREAD, WIDEST = 0.018, 3.0
#: Rows at which a source's own quantiles weigh as much as those of its language.
EVEN_WEIGHT = 200
#: Values that a sketch keeps of each size; groups below it are exact, larger ones within about 0.6 % of rank.
SKETCH_SIZE = 512
#: Fences are broadcast up to so many languages and sources, joined by their keys beyond.
MOST_BROADCAST = 50_000


def _repeated(found: Column) -> Column:
    """Words in windows of five that occur at least twice among the words ``found``."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))),
            lambda x: x["i"],
        )))
        steps = let(starts, lambda s: F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = let(found, lambda w: F.transform(indexes(F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def _base(text: Column) -> Column:
    """All that is counted in one text, as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
        )

    return F.struct(
        let(words(text), counts).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.length(text).cast("bigint").alias("chars"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
    )


def _named(counted: DataFrame) -> DataFrame:
    """``__q_base`` spread over the result columns, and ``base_failed``."""
    out = counted.withColumns({
        "n_words": F.col("__q_base.w.n_words"), "word_chars": F.col("__q_base.w.word_chars"), "n_symbols": F.col("__q_base.n_symbols"), "n_text_chars": F.col("__q_base.chars"),
        "n_lines": F.col("__q_base.l.n_lines"), "n_dup_lines": F.col("__q_base.l.n_dup_lines"), "n_repeat_words": F.col("__q_base.w.n_repeat_words"),
    }).drop("__q_base")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts and ``base_failed``; a null text counts as empty.

    Windows are compared by 64-bit hashes inside one document. Columns of ``df``
    with the name of a result are replaced.
    """
    return _named(df.withColumn("__q_base", _base(F.col(text_col))))


def _ratios() -> dict[str, Column]:
    """Mean word length; plain characters for each symbol or white space; logarithm of the mean line length; and the shares that are zero in good text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("n_text_chars"), F.lit(1)).cast("double")
    plain = (F.col("word_chars") - F.col("n_symbols")).cast("double")
    return {
        "word_length": F.col("word_chars") / n,
        "plain_odds": plain / F.greatest(F.col("n_text_chars") - plain, F.lit(1)),
        "line_length": F.log(chars / F.greatest(F.col("n_lines"), F.lit(1))),
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each language and source: rows that pass the base rules and the ceilings, and a KLL sketch of every ratio over them.

    Sketches of further data merge into these. A group without such a row has empty ones and is judged by its language.
    """
    ratios = _ratios()
    sound = ~F.exists(F.array(F.col("base_failed"), *(ratios[k] > bounds[1] for k, bounds in RATIOS.items() if bounds)), lambda x: x)
    return counted.groupBy(F.col(lang_col).alias("__q_lang"), F.col(source_col).alias("__q_source")).agg(
        F.count_if(sound).alias("__q_n"), *(F.kll_sketch_agg_double(F.when(sound, ratios[k]), SKETCH_SIZE).alias(f"__q_sketch_{k}") for k in RATIOS)
    )


def _middle_and_spread(sketch: str) -> Column:
    """Null for an empty sketch."""
    low, middle, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (OUTER, 0.5, 1 - OUTER))
    return F.when(F.col("__q_n") > 0, F.struct(middle.alias("middle"), (middle - low).alias("below"), (high - middle).alias("above")))


def fences(by_source: DataFrame) -> DataFrame:
    """``(__q_lang, __q_source, __q_low_*, __q_high_*)`` from ``sketches``.

    Medians and spreads of a source count by its rows against those of its
    language, with the same rule at every size. A spread is at most ``WIDEST``
    times the language's, so that a junk-ridden source does not judge itself, and
    at least ``LEAST_SPREAD`` of the median, so that many copies of one text in a
    source do not shut out the rest.
    """
    own = by_source.select("__q_lang", "__q_source", "__q_n", *(_middle_and_spread(f"__q_sketch_{k}").alias(f"__own_{k}") for k in RATIOS))
    merged = by_source.groupBy("__q_lang").agg(F.sum("__q_n").alias("__q_n"), *(F.kll_merge_agg_double(f"__q_sketch_{k}", SKETCH_SIZE).alias(f"__q_sketch_{k}") for k in RATIOS))
    whole = merged.select(F.col("__q_lang").alias("__l"), *(_middle_and_spread(f"__q_sketch_{k}").alias(f"__all_{k}") for k in RATIOS))
    joined = own.join(whole, F.col("__q_lang").eqNullSafe(F.col("__l")))
    weight = F.col("__q_n") / (F.col("__q_n") + EVEN_WEIGHT)
    out = []
    for k, bounds in RATIOS.items():
        mine, every = F.col(f"__own_{k}"), F.col(f"__all_{k}")
        mixed = {f: F.coalesce(weight * mine[f], F.lit(0.0)) + (1 - weight) * every[f] for f in ("middle", "below", "above")}
        least = LEAST_SPREAD * F.abs(mixed["middle"])
        low, high = (mixed["middle"] + way * SPREAD * F.greatest(F.least(mixed[f], WIDEST * F.greatest(every[f], least)), least) for f, way in (("below", -1), ("above", 1)))
        if bounds:  # a fence of its own only where the lower quartile is above zero too
            low, high = F.lit(None).cast("double"), F.when(mixed["middle"] > mixed["below"], F.greatest(high, F.lit(bounds[0]))).otherwise(bounds[0])
        out += [low.alias(f"__q_low_{k}"), high.alias(f"__q_high_{k}")]
    return joined.select("__q_lang", "__q_source", *out)


def _judge(counted: DataFrame, limits: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    side = F.broadcast(limits) if limits.count() <= MOST_BROADCAST else limits
    joined = counted.join(side, F.col(lang_col).eqNullSafe(F.col("__q_lang")) & F.col(source_col).eqNullSafe(F.col("__q_source")), "left")
    faults = [F.col("base_failed")]
    for k, ratio in _ratios().items():
        faults += [F.coalesce(ratio < F.col(f"__q_low_{k}"), F.lit(False)), F.coalesce(ratio > F.col(f"__q_high_{k}"), F.lit(False))]
    # one test of an array, which the optimizer cannot take apart: a filter on it never computes the counts again
    return joined.withColumn("kept", ~F.exists(F.array(*faults), lambda x: x)).drop(*limits.columns)


def _clear(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` without columns that bear a name used here, but for those that are needed."""
    return df.drop(*(c for c in df.columns if c.startswith("__q_") and c not in needed))


def quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns of ``df`` without the text, with base counts, ``base_failed`` and ``kept``.

    ``kept`` is false if a base rule fails or a ratio lies beyond a fence of the
    row's language and source. Null languages and sources form groups of their
    own; null texts count as empty and fail; repeated rows count each; an empty
    table gives an empty result. Columns of ``df`` named as a result are replaced,
    others that begin with ``__q_`` are dropped. Texts are read once: the counts
    are kept in the shared checkpoint folder. KLL sketches are randomised: in
    groups of more than ``SKETCH_SIZE`` rows fences may differ a little from run to
    run, and with them the verdict on rows next to a fence.
    """
    counted = checkpoint(base_counts(_clear(df, text_col, lang_col, source_col), text_col).drop(text_col))
    return _judge(counted, checkpoint(fences(sketches(counted, lang_col, source_col))), lang_col, source_col)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, unchanged, that ``quality`` keeps. Texts are read twice rather than written between."""
    keys = {"__q_l": lang_col, "__q_s": source_col}
    narrow = df.select(*(F.col(c).alias(k) for k, c in keys.items()), _base(F.col(text_col)).alias("__q_base"))
    limits = checkpoint(fences(sketches(_named(narrow), "__q_l", "__q_s")))
    # all input columns lie in one struct, where no name can clash and the text is held once
    row = F.col("__q_row")
    held = df.select(F.struct(*df.columns).alias("__q_row")).select("__q_row", *(row[c].alias(k) for k, c in keys.items()), _base(row[text_col]).alias("__q_base"))
    judged = _judge(_named(held), limits, "__q_l", "__q_s").filter("kept")
    return judged.select(*(row[c].alias(c) for c in df.columns))
