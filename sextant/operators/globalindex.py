"""The global index: entities of all corpora, merged by folded name.

Tables carry corpus_id as a column; nothing loops over corpora.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.scratch import is_cut, spread


def local_entities(entities: DataFrame, gkey: str = "gkey") -> DataFrame:
    """``gkey, cid, key, name, doc_count, mention_count`` and what the merge needs.
    entities: corpus_id, key, name, type, auto, doc_count, mention_count, years, gkey."""
    return entities.select(F.col(gkey).alias("gkey"), F.col("corpus_id").alias("cid"), "key", "name", "type", "description", "auto", "doc_count", "mention_count", "first_year", "last_year", "aliases")


def spellings(local: DataFrame) -> DataFrame:
    """``gkey, cid, key`` of the entities that one corpus has under several keys."""
    many = local.groupBy("gkey", "cid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gkey", "cid")
    return local.join(many, ["gkey", "cid"], "left_semi").select("gkey", "cid", "key")


def distinct_docs(local: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents per (gkey, cid) where several spellings of one corpus merged.
    mentions: corpus_id, key, doc_id."""
    keys = spellings(local)
    found = mentions.select(F.col("corpus_id").alias("cid"), "key", "doc_id").join(keys, ["cid", "key"])
    return found.groupBy("gkey", "cid").agg(F.countDistinct("doc_id").alias("docs"))


def merge(local: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Global entities: sums over corpora, counted per corpus first (distinct
    documents where spellings merged), names from the representative entity: not
    automatic, most documents, then corpus and key."""
    per = local.groupBy("gkey", "cid").agg(
        F.sum("doc_count").alias("docs_sum"), F.sum("mention_count").alias("mentions"), F.min("auto").alias("auto"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year")
    )
    if variants is not None:
        per = per.join(variants, ["gkey", "cid"], "left").withColumn("docs_sum", F.coalesce("docs", "docs_sum")).drop("docs")
    total = per.groupBy("gkey").agg(
        F.sum("docs_sum").alias("doc_count"), F.sum("mentions").alias("mention_count"), F.count(F.lit(1)).alias("n_corpora"), F.min("auto").alias("auto"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year")
    )
    order = Window.partitionBy("gkey").orderBy("auto", F.desc("doc_count"), "cid", "key")
    shown = local.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("gkey", "name", "type", "description")
    aliases = local.select("gkey", F.explode_outer("aliases").alias("a")).groupBy("gkey").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    return total.join(shown, "gkey").join(aliases, "gkey", "left")


def type_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("auto").alias("auto"))


def corpus_bounds(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """``cid, docs, lo, hi`` per corpus, years within bounds."""
    inside = F.when(F.col("year").between(lo, hi), F.col("year"))
    return docs.groupBy(F.col("corpus_id").alias("cid")).agg(F.count(F.lit(1)).alias("docs"), F.min(inside).alias("lo"), F.max(inside).alias("hi"))


def years(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """``cid, year, n`` within each corpus' own bounds."""
    joined = docs.select(F.col("corpus_id").alias("cid"), "year").join(bounds.select("cid", "lo", "hi"), "cid")
    return joined.filter(F.col("year").between(F.col("lo"), F.col("hi"))).groupBy("cid", "year").agg(F.count(F.lit(1)).alias("n"))


def total_years(per_corpus: DataFrame) -> DataFrame:
    return per_corpus.groupBy("year").agg(F.sum("n").alias("n"))


def corpus_links(edges: DataFrame, local: DataFrame) -> DataFrame:
    """``cid, a, b, docs``: undirected links between global entities within each corpus,
    the most documents over spelling variants.  edges: corpus_id, src_key, dst_key, docs."""
    k = local.select(F.col("cid").alias("corpus_id"), "key", "gkey")
    a = k.select("corpus_id", F.col("key").alias("src_key"), F.col("gkey").alias("ga"))
    b = k.select("corpus_id", F.col("key").alias("dst_key"), F.col("gkey").alias("gb"))
    if is_cut(edges):  # written: their number is known, and tasks follow it
        n = edges.count()
        edges = spread(spread(edges, n, "corpus_id", "src_key").join(a, ["corpus_id", "src_key"]), n, "corpus_id", "dst_key")
        joined = edges.join(b, ["corpus_id", "dst_key"]).filter("ga <> gb")
    else:
        joined = edges.join(a, ["corpus_id", "src_key"]).join(b, ["corpus_id", "dst_key"]).filter("ga <> gb")
    return joined.groupBy(F.col("corpus_id").alias("cid"), F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.max("docs").alias("docs"))


def sum_links(per: DataFrame) -> DataFrame:
    return per.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("n_corpora"))


def links(edges: DataFrame, local: DataFrame) -> DataFrame:
    """Links between global entities, summed over corpora."""
    return sum_links(corpus_links(edges, local))


def replaced(old: DataFrame, new: DataFrame, gone: list[str]) -> DataFrame:
    """A table with a row's corpus in cid, without the rows of some corpora and with
    the new ones."""
    return old.filter(~F.col("cid").isin(*gone)).unionByName(new, allowMissingColumns=True)


def merged_again(old: DataFrame, old_local: DataFrame, local: DataFrame, variants: DataFrame, new_local: DataFrame, gone: list[str]) -> DataFrame:
    """Global entities after some corpora changed: only those that an old or a new row
    of these corpora belongs to are merged again, the others stay as they are."""
    touched = old_local.filter(F.col("cid").isin(*gone)).select("gkey").union(new_local.select("gkey")).distinct()
    again = merge(local.join(touched, "gkey", "left_semi"), variants.join(touched, "gkey", "left_semi"))
    return old.join(touched, "gkey", "left_anti").unionByName(again)


def links_again(old: DataFrame, old_per: DataFrame, new_per: DataFrame, gone: list[str]) -> DataFrame:
    """Links after some corpora changed: what these gave is subtracted, what they give
    now is added, and a link that no corpus has any more goes."""
    took = old_per.filter(F.col("cid").isin(*gone)).select("a", "b", (-F.col("docs")).alias("docs"), F.lit(-1).cast("bigint").alias("n_corpora"))
    gave = new_per.select("a", "b", "docs", F.lit(1).cast("bigint").alias("n_corpora"))
    moved = took.unionByName(gave).groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("n_corpora").alias("n_corpora"))
    return old.unionByName(moved).groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("n_corpora").alias("n_corpora")).filter("n_corpora > 0")


def neighbours(all_links: DataFrame, gkey: str) -> DataFrame:
    near = all_links.filter((F.col("a") == gkey) | (F.col("b") == gkey))
    return near.select(F.when(F.col("a") == gkey, F.col("b")).otherwise(F.col("a")).alias("gkey"), "docs")


def relations(rows: DataFrame) -> DataFrame:
    """Relations of one entity over corpora: the most documents per corpus and
    (direction, type, other), summed; dates ignore empty strings.
    rows: cid, dir, type, gkey, docs, first_date, last_date."""
    first, last = F.nullif("first_date", F.lit("")), F.nullif("last_date", F.lit(""))
    per = rows.groupBy("cid", "dir", "type", "gkey").agg(F.max("docs").alias("docs"), F.min(first).alias("first_date"), F.max(last).alias("last_date"))
    return per.groupBy("dir", "type", "gkey").agg(F.sum("docs").alias("docs"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def presence(local: DataFrame, variants: DataFrame, gkey: str) -> DataFrame:
    """A global entity in each corpus: its best documented key, documents, mentions."""
    own = local.filter(F.col("gkey") == gkey)
    per = own.groupBy("gkey", "cid").agg(F.max_by("key", F.struct("doc_count", "key")).alias("key"), F.sum("doc_count").alias("n"), F.sum("mention_count").alias("mentions"))
    return per.join(variants, ["gkey", "cid"], "left").select("cid", "key", F.coalesce("docs", "n").alias("docs"), "mentions").orderBy(F.desc("docs"), "cid")


def pair_documents(mentions: DataFrame, local: DataFrame, a: str, b: str) -> DataFrame:
    """Documents that mention both of two global entities, per corpus."""
    keys = local.filter(F.col("gkey").isin(a, b)).select(F.col("cid").alias("corpus_id"), "key", "gkey")
    found = mentions.select("corpus_id", "key", "doc_id").join(keys, ["corpus_id", "key"]).select("corpus_id", "doc_id", "gkey").distinct()
    both = found.groupBy("corpus_id", "doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k = 2")
    return both.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("docs"))


def merged_top(per_corpus: DataFrame, limit: int = 400) -> DataFrame:
    """Top documents of all corpora: each corpus' first ``limit`` by mentions, then the first of those."""
    rank = F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.desc("mentions"), "doc_id"))
    return per_corpus.withColumn("rn", rank).filter(F.col("rn") <= limit).drop("rn").orderBy(F.desc("mentions"), "corpus_id", "doc_id").limit(limit)


def stamp(versions: DataFrame) -> str:
    """Hash of (corpus_id, version, title, settings) rows: changes when a rebuild is due."""
    rows = versions.agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct(*versions.columns)))).cast("binary"))).first()
    return rows[0]
