"""What several training-data operators share: words, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the separators between words: space and U+0009 .. U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows that Python works on at a time; keeps what long texts need small.
BATCH_ROWS = 500
#: The same where texts are encoded: distinct words are looked up once a batch.
ENCODED_ROWS = 1500
#: The same for narrow rows of numbers.
NARROW_ROWS = 50_000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: Column) -> Column:
    """Array of the maximal runs outside SEPARATORS; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, whatever the session makes
    them (Spark ends a batch at 64 MB of its own accord).  At the end of a task,
    memory that the worker no longer uses goes back to the machine."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def trim() -> None:
    """Workers live on between tasks: what is free should not stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for one write and are put back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Only where a session on one machine leaves it unset (as in tests) a temporary
    folder takes its place and is set for the session; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", root)
        _remove_at_exit(spark, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the program ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a
    lost executor costs only the reading of its files.  The write's shuffle files
    go with its end.  rows: the most rows of an Arrow batch during the write."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, {_CLEANUP: "true"} | ({_BATCH: str(rows)} if rows else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in tables:
        if path := df.__dict__.pop("scratch_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def clean() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session is already gone: nothing can reach the folder
            pass

    atexit.register(clean)
