"""Co-occurrence edges in tumbling page windows, with support and NPMI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.scratch import cut, spread

WINDOW, MAX_ENTITIES, MIN_DOCS = 5, 400, 2


def page_window(page_no: Column, window: int = WINDOW) -> Column:
    """Pages 1..window are window 0, and so on; null and non-positive pages are page 1."""
    return F.floor((F.greatest(F.coalesce(page_no, F.lit(1)), F.lit(1)) - 1) / window).cast("int")


def window_entities(mentions: DataFrame, window: int | None = WINDOW, max_entities: int = MAX_ENTITIES, rows: int = 0) -> DataFrame:
    """Sorted distinct entities of each (doc, window); windows with more than
    max_entities are hubs and left out before they are collected.  rows: how many
    mentions there are at most, where that is known.

    Rows are dealt by (doc, window) once: what follows, the distinct rows, their number
    and the collection, keeps that partitioning and is not shuffled again."""
    place = [page_window(F.col("page_no"), window).alias("win")] if window else []
    by = ["doc_id", "win"] if window else ["doc_id"]  # a constant among them would undo the partitioning
    dealt = spread(mentions.select("doc_id", *place, F.col("entity_id").alias("e")), rows, *by).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    found = dealt.withColumn("n", n).filter((F.col("n") > 1) & (F.col("n") <= max_entities)).groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return found if window else found.select("doc_id", F.lit(0).alias("win"), "es")


def pairs(windows: DataFrame) -> DataFrame:
    """Distinct (doc, src, dst) with src < dst that share a window; at most
    max_entities squared over two pairs come from one row.

    Windows are written and their pairs counted first: so many tasks get the pairs,
    dealt by (src, dst), which both the distinct rows and a count of documents keep."""
    windows, n = cut(windows.select("doc_id", "es")), F.size("es").cast("bigint")
    rows = windows.agg(F.sum(n * (n - 1) / 2).cast("bigint")).first()[0] or 0
    made = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return spread(windows.select("doc_id", F.explode(made).alias("p")).select("doc_id", "p.src", "p.dst"), rows, "src", "dst").distinct()


def support(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)


def npmi(joint: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information, 4 places; 1 when every document has the pair."""
    p = joint / n
    value = F.ln(p / ((a / n) * (b / n))) / -F.ln(p)
    return F.round(F.when(joint >= n, 1.0).otherwise(value), 4)


def edges(mentions: DataFrame, doc_counts: DataFrame, n_docs: int | Column, window: int | None = WINDOW, max_entities: int = MAX_ENTITIES, min_docs: int = MIN_DOCS, rows: int = 0) -> DataFrame:
    """``src, dst, docs, npmi``; doc_counts: entity_id, doc_count; rows: mentions at most."""
    found = cut(support(pairs(window_entities(mentions, window, max_entities, rows)), min_docs))
    links = found.count()
    a, b = (doc_counts.select(F.col("entity_id").alias(c), F.col("doc_count").alias(f"n_{c}")) for c in ("src", "dst"))
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return spread(spread(found, links, "src").join(a, "src"), links, "dst").join(b, "dst").select("src", "dst", "docs", npmi(F.col("docs"), F.col("n_src"), F.col("n_dst"), n).alias("npmi"))
