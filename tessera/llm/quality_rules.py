"""Quality rules: a table of thresholds compiled into one projection.

Every metric and every rule is a built-in expression, so one projection over the scan
judges each text, without a shuffle or a user function. A word is a run of other
characters than space and U+0009 to U+000D.

Repeats of five-word windows are found by hashing the windows (64 bits, within one
text). Most texts have no equal hashes and are done after a hash-set count; only the
others sort their windows, which takes n log n steps for a text of n words.

Defined cases: a null or empty text has no words and fails the base rule; very long texts
are judged whole; a value equal to a threshold meets it, so ties are settled; repeated rows
give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Words from which the share of stop words is judged.
LONG = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "be", "have", "with", "for", "it", "der", "die", "das", "und", "ist", "nicht", "von", "mit", "zu", "den", "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "el", "los", "las", "y", "por", "con", "no", "se")

#: (rule, metric, smallest, largest) — null: no bound. A text is kept if it meets all.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word length", "mean_word_chars", 1.5, 30.0),
    ("symbols", "symbols_per_word", None, 0.3),
    ("stop words", "stop_word_ratio_if_long", 0.02, None),
    ("repeated lines", "dup_line_ratio", None, 0.5),
    ("bullet lines", "bullet_line_ratio", None, 0.9),
    ("words with a letter", "letter_word_ratio", 0.5, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words which occurs twice or more."""

    def sorted_windows(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(sorted_windows(h), lambda s: let(twice(s), covered))))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(counted)


def measured(df: DataFrame, text_col: str = "text") -> tuple[list[Column], DataFrame]:
    """The metrics of each text, and ``df`` with the arrays that they need."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.col("__words"), F.col("__lines")
    with_arrays = df.withColumns({"__words": words_of(F.col(text_col)), "__lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    columns = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.regexp_count(text, F.lit(r"(?m)^[ \t]*[-*•]")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin([form for w_ in STOP_WORDS for form in (w_, w_.capitalize())]))),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
    }
    return [c.cast("long").alias(k) for k, c in columns.items()], with_arrays


def judge(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the metrics, ``base_failed``, ``failed`` (names of rules not met) and ``kept``."""
    metrics, with_arrays = measured(df.select(id_col, text_col), text_col)
    found = with_arrays.select(id_col, *metrics)
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    derived = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio_if_long": F.when(F.col("n_words") < LONG, 1.0).otherwise(ratio("n_stop_words", "n_words")),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "letter_word_ratio": ratio("n_letter_words", "n_words"),
    }
    value = lambda m: derived.get(m, F.col(m))
    failed = [
        F.when(reduce(Column.__or__, [value(metric) < low] * (low is not None) + [value(metric) > high] * (high is not None)), F.lit(name))
        for name, metric, low, high in rules
    ]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )
