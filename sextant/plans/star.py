"""Engine tables over the star schema: an order is a document, a line number its
page, parts, suppliers, customers and nations are entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import mentions as M
from sextant.schema import GAZETTEER
from sextant.scratch import cut, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("doc_date"), F.year("o_orderdate").alias("year"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("collection"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("corpus_id"),
    )


def raw_mentions(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier",)) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    columns = {"supplier": "l_suppkey", "part": "l_partkey"}
    keys = F.array(*[F.concat(F.lit(f"{k}:"), F.col(columns[k]).cast("string")) for k in kinds])
    return line.select(
        F.explode(keys).alias("key"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.lit(1).alias("count"), F.lit(GAZETTEER).alias("src")
    )


def facts(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier",)) -> DataFrame:
    """Dealt by document, which what is counted per document keeps."""
    return M.mention_facts(spread(raw_mentions(spark, sf_dir, kinds), rows(spark, sf_dir, kinds), "doc_id"))


def rows(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier",)) -> int:
    """Raw mentions, of which facts are never more; the files' footers tell."""
    return len(kinds) * read(spark, sf_dir, "lineitem").count()


def entities(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier",)) -> DataFrame:
    """id, key, name, type, aliases, auto and statistics."""
    return _named(spark, sf_dir, kinds, M.entity_ids(M.entity_stats(facts(spark, sf_dir, kinds), documents(spark, sf_dir))))


def _named(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], ids: DataFrame) -> DataFrame:
    names = []
    if "supplier" in kinds:
        names.append(read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"), F.lit("company").alias("type")))
    if "part" in kinds:
        names.append(read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), F.lit("technology").alias("type")))
    named = names[0]
    for more in names[1:]:
        named = named.unionByName(more)
    return ids.join(named, "key").withColumn("aliases", F.array("name")).withColumn("auto", F.lit(0))


def mentions(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier",)) -> DataFrame:
    return M.encode(*_numbered(spark, sf_dir, kinds))


def corpus(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier",)) -> tuple[DataFrame, DataFrame]:
    """``entities`` and ``mentions`` from one pass over the facts and one numbering."""
    found, ids = _numbered(spark, sf_dir, kinds)
    return _named(spark, sf_dir, kinds, ids), M.encode(found, ids)


def _numbered(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Facts, written once and dealt by key, and the numbers of their keys."""
    found, n = cut(facts(spark, sf_dir, kinds)), rows(spark, sf_dir, kinds)
    ids = M.entity_ids(M.entity_stats(spread(found, n, "doc_id"), documents(spark, sf_dir)))
    return spread(found, n, "key"), ids


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> supplier "ordered from", with the order and its date as evidence."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src_key"), F.lit("ordered from").alias("type"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst_key"), F.col("l_orderkey").cast("string").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("doc_date"),
    )
