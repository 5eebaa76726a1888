"""Documents per year, in numbers or shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SERIES = 8


def year_totals(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    return docs.filter(F.col("year").between(lo, hi)).groupBy("year").agg(F.count(F.lit(1)).alias("total"))


def year_bounds(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """First and last year of the data within bounds, one row."""
    return docs.filter(F.col("year").between(lo, hi)).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))


def series(mentions: DataFrame, docs: DataFrame, entity_ids: list[int], lo: int, hi: int, share: bool = False, min_year_docs: int = 0) -> DataFrame:
    """``entity_id, year, value`` for every year that has documents, zeros included.

    With share, the value is the percentage of the year's documents, 2 places.
    Years with fewer than min_year_docs documents are left out."""
    picked = entity_ids[:MAX_SERIES]
    totals = year_totals(docs, lo, hi).filter(F.col("total") >= min_year_docs)
    own = mentions.filter(F.col("entity_id").isin(*picked)).select("entity_id", "doc_id").distinct()
    dated = own.join(docs.select(F.col("id").alias("doc_id"), "year"), "doc_id")
    counts = dated.groupBy("entity_id", "year").agg(F.count(F.lit(1)).alias("n"))
    grid = totals.withColumn("entity_id", F.explode(F.array(*[F.lit(e) for e in picked])))
    n = F.coalesce("n", F.lit(0))
    value = F.round(100.0 * n / F.col("total"), 2) if share else n.cast("double")
    return grid.join(counts, ["entity_id", "year"], "left").select("entity_id", "year", value.alias("value"))


def zero_filled(counts: DataFrame, lo: int, hi: int) -> DataFrame:
    """``year, n`` for every year from lo to hi."""
    years = counts.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def matrix(series_: DataFrame, names: DataFrame, entity_ids: list[int]) -> DataFrame:
    """Years by names; names: entity_id, name."""
    return series_.join(names, "entity_id").groupBy("year").pivot("name").agg(F.first("value")).fillna(0.0).orderBy("year")


def presets(config: list[dict], *packs: list[dict]) -> list[dict]:
    """Timeline presets of the configuration and packs, in order, one per title."""
    seen: dict[str, dict] = {}
    for preset in [p for group in (config, *packs) for p in group]:
        seen.setdefault(preset["title"], preset)
    return list(seen.values())
