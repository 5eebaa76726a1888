"""Mention facts, entity statistics and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.scratch import cut
from sextant.schema import GAZETTEER, NER_NEW, STRUCTURED


def drop_covered(raw: DataFrame) -> DataFrame:
    """Evidence from patterns or recognisers counts only on pages where the
    gazetteer did not already find the same key."""
    known = raw.filter(F.col("src") == GAZETTEER).select("doc_id", "page_no", "key").distinct()
    weak = raw.filter(~F.col("src").isin(GAZETTEER, STRUCTURED, NER_NEW)).join(known, ["doc_id", "page_no", "key"], "left_anti")
    return raw.filter(F.col("src").isin(GAZETTEER, STRUCTURED, NER_NEW)).unionByName(weak.select(*raw.columns))


def mention_facts(raw: DataFrame) -> DataFrame:
    """One row per (key, doc, page): the summed counts, where structured evidence
    counts nothing beside other evidence and 1 alone."""
    n = F.sum(F.when(F.col("src") != STRUCTURED, F.col("count")).otherwise(0))
    return raw.groupBy("key", "doc_id", "page_no").agg(F.greatest(n, F.lit(1)).cast("bigint").alias("count"))


def entity_stats(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, mentions and year span per key; undated documents leave the span open."""
    per_doc = facts.groupBy("key", "doc_id").agg(F.sum("count").alias("n"))
    dated = per_doc.join(documents.select(F.col("id").alias("doc_id"), "year"), "doc_id", "left")
    return dated.groupBy("key").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("n").alias("mention_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def entity_ids(stats: DataFrame) -> DataFrame:
    """Identifiers 1, 2, ... by documents (most first), then key."""
    return numbered(stats, "id", F.desc("doc_count"), F.asc("key"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with numbers 1, 2, ... in an order that has no ties.  Ranges of the order
    go to tasks; a row's number is its place there plus the rows of all ranges before
    (the only window without a partition sees a row per range)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(dealt.withColumn("n_place", F.monotonically_increasing_id()))
    task, place = F.shiftright("n_place", 33), F.col("n_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(task.alias("n_task")).agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("n_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("n_task", before.alias("n_before"))
    return held.withColumn("n_task", task).join(F.broadcast(offsets), "n_task").withColumn(name, (F.col("n_before") + place + 1).cast("int")).drop("n_task", "n_place", "n_before")


def encode(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Mentions by identifier; keys without one are dropped."""
    return facts.join(ids.select("key", F.col("id").alias("entity_id")), "key").select("entity_id", "doc_id", "page_no", "count")


def candidate_support(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct documents, and whether all pages are scanned (ocr), of keys that only a recogniser found."""
    new = raw.filter(F.col("src") == NER_NEW).join(pages.select("doc_id", "page_no", "ocr"), ["doc_id", "page_no"])
    return new.groupBy("key").agg(F.countDistinct("doc_id").alias("docs"), F.min("ocr").alias("ocr_only"))


def retained_candidates(support: DataFrame, min_docs: int, given_names: DataFrame | None = None) -> DataFrame:
    """Keys with enough documents; one seen on scanned pages only must start with a
    known given name.  Without a list of names no such key stays."""
    first = F.lower(F.split(F.regexp_replace("key", "^[^:]*:", ""), " ")[0])
    rows = support.filter(F.col("docs") >= min_docs).withColumn("given", first)
    clear = rows.filter(F.col("ocr_only") == 0).select("key")
    if given_names is None:
        return clear
    scanned = rows.filter(F.col("ocr_only") == 1).join(given_names.select(F.lower("name").alias("given")), "given", "left_semi")
    return clear.unionAll(scanned.select("key"))
