"""Staged documents and attachments.

Documents are staged as JSON lines in containers of bounded size, beside an index of
byte ranges: one document, or any set, is read by its ranges alone.  Attachments are
stored once per content, beside a manifest of who has them.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sextant.scratch import cut, drop

#: Bytes of a container, about; ranges nearer than this are fetched together.
CONTAINER_BYTES, GAP_BYTES = 64 << 20, 64 << 10
#: Hex digits of a content's hash that name its folder.
PREFIX = 2
TABLES = {"contents": "sha1 string, content binary, prefix string", "manifest": "relpath string, n int, name string, sha1 string, size bigint"}


# ------------------------------------------------------------------ documents
def write_documents(docs: DataFrame, path: str, id_col: str = "id", container_bytes: int = CONTAINER_BYTES) -> None:
    """Containers under ``path/containers`` and their index under ``path/index``: id,
    file, offset, length (of the line without its end).  A row of docs is a line, which
    keeps all its columns; repeated and null ids have a line each."""
    spark = docs.sparkSession
    line = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    lines = cut(docs.select(F.col(id_col).alias("id"), line.alias("line")).withColumn("size", F.octet_length("line").cast("bigint")))
    total = lines.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    n = max(1, -(-total // container_bytes))
    dealt = lines.withColumn("bucket", F.pmod(F.xxhash64("id", "line"), F.lit(n)).cast("int"))
    dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "id", "line").select("bucket", F.col("line").alias("value")).write.partitionBy("bucket").text(f"{path}/containers")
    before = Window.partitionBy("bucket").orderBy("id", "line").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("id", "bucket", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0).cast("bigint")).alias("offset"), F.col("size").alias("length"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/containers").select("path")
    files = files.select(F.col("path").alias("file"), F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int").alias("bucket"))
    placed.join(F.broadcast(files), "bucket").select("id", "file", "offset", "length").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/index")
    drop(lines)


def read_documents(spark: SparkSession, path: str, schema: StructType | str, ids: DataFrame | None = None) -> DataFrame:
    """Staged documents, all or those of ``ids`` (a column ``id``), in the given schema.
    A task opens one container after another and fetches ranges, near ones together;
    bytes between them are not read.  Containers are opened by Arrow's file systems."""
    index = spark.read.parquet(f"{path}/index")
    if ids is not None:
        index = index.join(ids.select("id").distinct(), "id", "left_semi")
    ranges = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, rows in batch.groupby("file", sort=False):
                yield pd.DataFrame({"line": [x.decode() for x in fetch(file, rows["offset"].tolist(), rows["length"].tolist())]})

    return ranges.mapInPandas(run, "line string").select(F.from_json("line", schema).alias("d")).select("d.*")


def fetch(file: str, offsets: list[int], lengths: list[int]) -> Iterator[bytes]:
    """Ranges of a file in ascending order; those less than GAP_BYTES apart by one read."""
    system, name = pyarrow.fs.FileSystem.from_uri(file)
    with system.open_input_file(name) as f:
        at = 0
        while at < len(offsets):
            to = at + 1
            while to < len(offsets) and offsets[to] - (offsets[to - 1] + lengths[to - 1]) < GAP_BYTES and offsets[to] - offsets[at] < CONTAINER_BYTES:
                to += 1
            start = offsets[at]
            data = f.read_at(offsets[to - 1] + lengths[to - 1] - start, start)
            yield from (data[o - start : o - start + n] for o, n in zip(offsets[at:to], lengths[at:to], strict=True))
            at = to


# ------------------------------------------------------------------ attachments
def mail_attachments(files: DataFrame) -> DataFrame:
    """``relpath, n, name, content`` of the attachments of mails (relpath, content), n
    from 1 in order.  What is no mail has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["relpath"], batch["content"], strict=True):
                parts = email.message_from_bytes(bytes(data or b""), policy=email.policy.compat32).walk()
                named = [(p.get_filename(), p.get_payload(decode=True) or b"") for p in parts if not p.is_multipart() and p.get_filename()]
                rows += [(path, k, name, content) for k, (name, content) in enumerate(named, 1)]
            yield pd.DataFrame(rows, columns=["relpath", "n", "name", "content"])

    return files.select("relpath", "content").mapInPandas(run, "relpath string, n int, name string, content binary")


def stage_attachments(rows: DataFrame, root: str) -> None:
    """Contents that the store does not have are added, each once, and the manifest gets
    a row per attachment: relpath, n, name, sha1, size.  rows: relpath, n, name, content.

    Which row brings a content is settled among hashes; contents are not shuffled.
    Rows are written once, so that mails are taken apart once and not for every use."""
    spark = rows.sparkSession
    hashed = cut(rows.withColumn("sha1", F.sha1("content")).withColumn("size", F.octet_length("content").cast("bigint")))
    first = hashed.groupBy("sha1").agg(F.min(F.struct("relpath", "n")).alias("by")).select("sha1", "by.relpath", "by.n")
    if (stored := _stored(spark, root, "contents")) is not None:
        first = first.join(stored.select("sha1"), "sha1", "left_anti")
    new = hashed.join(first, ["sha1", "relpath", "n"], "left_semi").dropDuplicates(["sha1"])
    new.select("sha1", "content", F.substring("sha1", 1, PREFIX).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(f"{root}/contents")
    hashed.select("relpath", "n", "name", "sha1", "size").write.mode("append").parquet(f"{root}/manifest")
    drop(hashed)


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}") if exists else None


def stored_attachments(spark: SparkSession, root: str) -> DataFrame:
    """``sha1, content, references``: every stored content and how many attachments have it."""
    counts = _stored(spark, root, "manifest").groupBy("sha1").agg(F.count(F.lit(1)).alias("references"))
    return _stored(spark, root, "contents").join(counts, "sha1", "left").select("sha1", "content", F.coalesce("references", F.lit(0).cast("bigint")).alias("references"))


def forget(spark: SparkSession, root: str, gone: DataFrame) -> int:
    """Sources that vanished (relpath) leave the manifest, and contents that none names
    any more go: only the folders that hold one are written anew.  Gives their number."""
    manifest, contents = f"{root}/manifest", f"{root}/contents"
    left = cut(_stored(spark, root, "manifest").join(gone.select("relpath").distinct(), "relpath", "left_anti"))
    left.write.mode("overwrite").parquet(manifest)
    stored = _stored(spark, root, "contents")
    orphans = cut(stored.select("sha1", "prefix").join(left.select("sha1").distinct(), "sha1", "left_anti"))
    folders = [r[0] for r in orphans.select("prefix").distinct().collect()]  # at most 16 ** PREFIX
    if folders:
        kept = cut(stored.filter(F.col("prefix").isin(*folders)).join(orphans.select("sha1"), "sha1", "left_anti"))
        for folder in folders:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{contents}/prefix={folder}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        kept.write.mode("append").partitionBy("prefix").parquet(contents)
    n = orphans.count()
    drop(left, orphans)
    return n
