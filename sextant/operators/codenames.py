"""Codenames: words written almost only in capitals, told from misreadings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import is_all_caps

#: Letters that optical recognition confuses, as pairs.  Fixed values.
CONFUSED = "MW MN NH HR HN DO OQ OC CG PF FE BS BE BR RP RK LI IT UV VW VY KX EC OU".split()
#: Parts of marking banners, and shapes of garbled ones.  Fixed values.
BANNER = "SECRE|NOFOR|CLASSIF|CONFID|UNCLAS|FOUO|RELTO|OFFICIAL|COMINT|ORCON"
GARBLED = "^(?:[TSIUWVHCLO1]*REL|[TSIHUW]+)$"


def words(pages: DataFrame, min_letters: int = 5, split_caps: bool = True) -> DataFrame:
    """``doc_id, ocr, w`` for every word of plain letters; pages of capitals apart."""
    rows = pages.filter(~is_all_caps(F.col("text"))) if split_caps else pages
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"\b[A-Za-z]{{{min_letters},}}\b"), F.lit(0))
    return rows.select("doc_id", "ocr", F.explode(found).alias("w"))


def token_stats(pages: DataFrame) -> DataFrame:
    """Per word in capitals: ``token, caps_n, docs, text_docs, other_n``."""
    upper = F.col("w") == F.upper("w")
    # one row per (token, document) first: distinct counts stay map-side sums
    per = words(pages).groupBy(F.upper("w").alias("token"), "doc_id").agg(
        F.sum(F.when(upper, 1).otherwise(0)).alias("caps"), F.sum(F.when(upper, 0).otherwise(1)).alias("other"), F.max(F.when(upper & (F.col("ocr") == 0), 1).otherwise(0)).alias("layer")
    )
    return per.groupBy("token").agg(
        F.sum("caps").alias("caps_n"), F.sum(F.when(F.col("caps") > 0, 1).otherwise(0)).alias("docs"), F.sum("layer").alias("text_docs"), F.sum("other").alias("other_n")
    )


def known_counts(pages: DataFrame, known: DataFrame) -> DataFrame:
    """How often known tokens (column token) stand on pages of capitals."""
    caps = pages.filter(is_all_caps(F.col("text")))
    return words(caps, split_caps=False).select(F.col("w").alias("token")).join(known.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("known_n"))


def near_marking(stats: DataFrame, markings: DataFrame) -> DataFrame:
    """Tokens within 1 or 2 edits of a marking word (column m): 1 for words under
    six letters, or of six if the token is trusted.  Candidates meet by a shared
    deletion neighbourhood, not as a product."""
    a = stats.select("token", (F.col("text_docs") >= 2).alias("trusted"), F.explode(deletions(F.col("token"), 2)).alias("d"))
    b = markings.select("m", F.explode(deletions(F.col("m"), 2)).alias("d"))
    met = a.join(b, "d").select("token", "trusted", "m").distinct()
    limit = F.when((F.length("m") < 6) | ((F.length("m") == 6) & F.col("trusted")), 1).otherwise(2)
    return met.filter(F.levenshtein("token", "m") <= limit).select("token").distinct()


def deletions(word: Column, depth: int = 1) -> Column:
    """The word and every form with up to ``depth`` letters dropped."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    out = F.concat(F.array(word), once(word))
    for _ in range(depth - 1):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda w: F.length(w) > 0), once))))
    return F.array_distinct(out)


def look_alike(w: Column, v: Column) -> Column:
    """v is w with a letter dropped, added, or swapped for one that is confused with it."""
    pairs = F.array(*[F.lit(x) for p in CONFUSED for x in (p, p[::-1])])
    differing = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, k, F.lit(1)), F.substring(v, k, F.lit(1)))), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1)
    )
    return (F.length(w) != F.length(v)) | ((F.size(differing) == 1) & F.array_contains(pairs, differing[0]))


def misreadings(candidates: DataFrame, vocabulary: DataFrame, close: int = 3, far: int = 20, min_freq: int = 10) -> DataFrame:
    """Candidates (token, freq) that are a misreading of a far more common word:
    3 times as common for look-alikes, else 20 times.  Words meet where dropping at
    most one letter from each makes them equal.  vocabulary: token, freq, known."""
    c = candidates.select(F.col("token").alias("w"), F.col("freq").alias("fw"), F.explode(deletions(F.col("token"))).alias("d"))
    v = vocabulary.filter((F.col("freq") >= min_freq) | F.col("known")).select(F.col("token").alias("v"), F.col("freq").alias("fv"), F.explode(deletions(F.col("token"))).alias("d"))
    met = c.join(v, "d").filter((F.col("w") != F.col("v")) & (F.col("fv") >= close * F.col("fw")))
    bad = met.filter((F.col("fv") >= far * F.col("fw")) | look_alike(F.col("w"), F.col("v")))
    return bad.select(F.col("w").alias("token")).distinct()


def segments(word: str, known: frozenset[str], least: int = 3) -> bool:
    """Whether a word is two or more known words run together."""
    best = {0: 0}
    for end in range(least, len(word) + 1):
        parts = [best[at] + 1 for at in best if at <= end - least and word[at:end] in known]
        if parts:
            best[end] = max(parts)
    return best.get(len(word), 0) >= 2


def segments_udf(known: frozenset[str], least: int = 3):
    @F.pandas_udf("boolean")
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda w: segments(w, known, least))

    return check


def detect(pages: DataFrame, known: DataFrame, markings: DataFrame, stop: tuple[str, ...] = (), english: frozenset[str] = frozenset()) -> DataFrame:
    """``token, docs`` of accepted codenames.  known: token of pack aliases in
    capitals; markings: m; english: words in capitals (without it, tokens seen only
    in recognised text are all rejected)."""
    stats = token_stats(pages)
    share = F.col("caps_n") / (F.col("caps_n") + F.col("other_n"))
    ordinary = F.col("token").isin(*english) if english else F.lit(False)
    ok = F.when(ordinary, (share >= 0.97) & (F.col("docs") >= 3) & (F.col("other_n") <= 2)).otherwise(share >= 0.85)
    rows = stats.filter((F.col("docs") >= 2) & ~F.col("token").rlike(BANNER) & ~F.col("token").rlike(GARBLED) & ok)
    if stop:
        rows = rows.filter(~F.col("token").isin(*stop))
    rows = rows.join(known.select("token").distinct(), "token", "left_anti")
    rows = rows.join(near_marking(rows, markings), "token", "left_anti")
    layer = F.col("text_docs") > 0
    rows = rows.filter(layer | segments_udf(frozenset(w for w in english if len(w) >= 3))(F.col("token"))) if english else rows.filter(layer)
    freq = stats.join(known_counts(pages, known), "token", "full").select("token", (F.coalesce("caps_n", F.lit(0)) + F.coalesce("other_n", F.lit(0)) + F.coalesce("known_n", F.lit(0))).alias("freq"))
    vocabulary = freq.join(known.select("token").distinct().withColumn("known", F.lit(True)), "token", "left").fillna(False, ["known"])
    unsure = rows.filter(F.col("text_docs") < 2).join(freq, "token").select("token", "freq")
    return rows.join(misreadings(unsure, vocabulary), "token", "left_anti").select("token", "docs")


def surname_veto(codenames: DataFrame, spans: DataFrame, min_docs: int = 2) -> DataFrame:
    """Codenames without those that are the surname of full names in enough
    documents.  spans: doc_id, name (normalised, in capitals or not)."""
    last = F.upper(F.element_at(F.split("name", " "), -1))
    seen = spans.filter(F.size(F.split("name", " ")) >= 2).select("doc_id", last.alias("token")).distinct()
    veto = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    return codenames.join(veto, "token", "left_anti")


def as_entities(codenames: DataFrame) -> DataFrame:
    return codenames.select(F.concat(F.lit("program:"), "token").alias("key"), F.col("token").alias("name"), F.lit("program").alias("type"), F.array("token").alias("aliases"), F.lit(1).alias("auto"))
