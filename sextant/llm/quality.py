"""Quality rules: a table of thresholds compiled into one native projection.

Measures are plain Column expressions over the words and lines of a text;
``RULES`` states the accepted interval of each ratio, and ``verdict`` turns the
table into a single conjunction.  There is no shuffle and no Python: the plan
is scan -> project.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import let, words_of

#: Function words of the four languages served.  Fixed values.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this at are an from he or "
    "de la le les et des en un une que dans pour est sur au du par qui ne "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine es auch als "
    "el los y las del se por con una no su para lo más al"
).split()
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """The ratio numerator/denominator must lie in [low, high]; a null bound is open."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table, on the measures that ``measures`` computes.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.15),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("letter_words", "n_letter_words", "n_words", 0.6, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def repeat_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found at least twice in the array.

    Windows are compared by a 64-bit hash first: if all differ, none repeats.
    Otherwise (hash, start) pairs are sorted, neighbours of equal hash are
    compared word by word, and the union of their windows is measured.
    """

    def same(s: Column, k: Column, other: Column) -> Column:
        a, b = s[k], s[other]
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hashes) - 1
        found = let(
            pairs,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        F.when(k > 0, same(s, k, F.greatest(k - 1, F.lit(0)))).otherwise(False)
                        | F.when(k < last, same(s, k, F.least(k + 1, last))).otherwise(False),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        return F.aggregate(
            F.array_sort(found),
            F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")),
            lambda acc: acc["n"],
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(some)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with every measure the rules refer to.

    A null text counts as an empty one: all measures are zero.  Repeated rows
    stay repeated; other columns of the input are not read.
    """
    text = F.coalesce(F.col("q_text"), F.lit(""))
    words, lines = F.col("q_words"), F.col("q_lines")
    size = lambda c: F.size(c).cast("bigint")
    base = df.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text"))
    parts = base.select(
        "q_id",
        "q_text",
        words_of(F.col("q_text")).alias("q_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("q_lines"),
    )
    return parts.select(
        F.col("q_id").alias("doc_id"),
        size(words).alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
        size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean; a zero denominator passes a rule."""
    out = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        if r.low is not None:
            out = out & ((bottom == 0) | (top >= bottom * r.low))
        if r.high is not None:
            out = out & ((bottom == 0) | (top <= bottom * r.high))
    return out


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` (too short or too repetitive) and ``kept``.

    Empty and null texts have no word, so they fail the base rule.  An empty
    table gives an empty result.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(df, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
