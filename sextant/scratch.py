"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).  Only a session on
    one machine that sets none gets a temporary one: on a cluster each executor would
    write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, removed when the program ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet and read again: lineage ends, readers prune
    columns and push filters, and sizes are known to the planner."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["cut_path"] = path
    return out


def is_cut(df: DataFrame) -> bool:
    """Whether the rows come straight from files of ``cut``."""
    return "cut_path" in df.__dict__


#: Rows that one task sorts or hashes at once.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The rows dealt by columns, to more tasks than the session shuffles to where their
    number (or a bound of it) asks for it, so that no task's share grows with the table."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *columns) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*columns)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again."""
    for df in tables:
        if path := df.__dict__.pop("cut_path", None):
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already gone: nothing can reach the folder
        pass
