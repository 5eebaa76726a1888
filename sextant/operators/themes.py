"""Theme tagging by merged patterns, one alternation per case mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.text import is_all_caps, java_regex

MIN_HITS = 3


@dataclass(frozen=True)
class Theme:
    """insensitive and sensitive: patterns counted without and with regard to case."""

    name: str
    insensitive: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()


def _count(text: Column, patterns: tuple[str, ...], flags: str) -> Column:
    if not patterns:
        return F.lit(0)
    return F.regexp_count(text, F.lit(flags + "|".join(f"(?:{java_regex(p)})" for p in patterns)))


def page_hits(text: Column, theme: Theme, caps: Column) -> Column:
    """Hits of both alternations; on a page of capitals all patterns ignore case."""
    merged = _count(text, theme.insensitive + theme.sensitive, "(?iu)")
    return F.when(caps, merged).otherwise(_count(text, theme.insensitive, "(?iu)") + _count(text, theme.sensitive, ""))


def theme_mentions(pages: DataFrame, themes: list[Theme], min_hits: int = MIN_HITS) -> DataFrame:
    """``doc_id, page_no, key, count``: pages with hits of themes that reach
    min_hits in their document."""
    text, caps = F.coalesce("text", F.lit("")), is_all_caps(F.col("text"))
    hits = F.array(*[F.struct(F.lit(f"idea:{t.name}").alias("key"), page_hits(text, t, caps).alias("count")) for t in themes])
    rows = pages.select("doc_id", "page_no", F.explode(hits).alias("h")).select("doc_id", "page_no", "h.key", "h.count").filter(F.col("count") > 0)
    total = F.sum("count").over(Window.partitionBy("doc_id", "key"))
    return rows.withColumn("total", total).filter(F.col("total") >= min_hits).drop("total")
