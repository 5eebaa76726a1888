"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.  Columns that the
input has beyond those are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm import langid, mixing, packing, similar, substring
from sextant.llm.common import materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null texts, texts without a
    letter, and texts that no language fits better than another.  A missing
    language is filled in."""
    found = langid.predict(docs, langid.train(docs), carry=COLUMNS)
    return found.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, Jaccard similarity 0.8
    or more) the row with the smallest id stays, a null id last; of rows that
    repeat id and text, one.  Different texts stay, whatever their ids."""
    groups = similar.similar_documents(docs, similarity=0.8, ngram=5)
    own = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    key = ["no_id", "id_key", "text_key"]  # without nulls, so that join and window share one shuffle
    named = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id_key")]
    stay = materialise(groups.filter(own).select(*named, "text_key").distinct(), "stay")
    release(groups)
    kept = docs.select(*COLUMNS, *named, F.xxhash64(F.col("text").cast("binary")).alias("text_key")).join(stay, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("lang", "source", "n_chars")))
    return kept.withColumn("first", first).filter("first = 1").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a text of which nothing
    is left goes, an untouched text stays as it is."""
    found = substring.remove_repeats(docs, carry=("lang", "source", "n_chars"), untouched=True)
    cut = F.col("n_removed") > 0
    left = found.filter(~cut | (F.col("kept") != ""))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the production mixture; one that is taken in several epochs
    gives a row for each."""
    chosen = mixing.mix(docs, carry=COLUMNS)
    return chosen.select(*[F.col(f"c_{k}").alias(c) for k, c in enumerate(COLUMNS)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens: a row per piece with its sequence and offset."""
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, cached=60_000, rows=500)  # beside what four stages left in memory
    return packing.assign(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Compression, fingerprints and tokenizers have no SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = materialise(made, f"stage-{k + 1}")
            release(docs)  # what the stage before wrote
        docs = made
    return docs
