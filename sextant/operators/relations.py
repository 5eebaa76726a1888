"""Typed relations: evidence per document, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.scratch import spread


def relation_docs(raw: DataFrame, ids: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """Distinct (src, dst, type, doc) by identifier.  raw: src_key, type, dst_key,
    doc_id; both ends must be surviving entities, and no relation is a loop.

    Without ids, raw has src, dst and doc_date itself, and at most ``rows`` rows: they
    are dealt once by (src, dst), which a summary keeps."""
    if ids is None:
        dealt = spread(raw.filter(F.col("src") != F.col("dst")), rows, "src", "dst")
        return dealt.groupBy("src", "dst", "type", "doc_id").agg(F.min("doc_date").alias("doc_date"))
    a = ids.select(F.col("key").alias("src_key"), F.col("id").alias("src"))
    b = ids.select(F.col("key").alias("dst_key"), F.col("id").alias("dst"))
    return raw.join(a, "src_key").join(b, "dst_key").filter(F.col("src") != F.col("dst")).select("src", "dst", "type", "doc_id").distinct()


def relation_summary(evidence: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Documents and first and last date of each relation.  Dates are strings; an
    empty date is the smallest.  Without documents, evidence has doc_date itself."""
    date = F.coalesce("doc_date", F.lit("")).alias("doc_date")
    if documents is None:
        dated = evidence.select("src", "dst", "type", date)
    else:
        dated = evidence.join(documents.select(F.col("id").alias("doc_id"), date), "doc_id")
    return dated.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_date").alias("first_date"), F.max("doc_date").alias("last_date"))


def undirected(relations: DataFrame) -> DataFrame:
    """Relations as edges: both directions and all types summed."""
    return relations.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("docs").alias("docs"))
