"""Streaming counterparts of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.sources import discover, formats

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def new_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive below a folder: the checkpoint is the manifest."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return stream.withColumn("relpath", F.col("path")).withColumn("kind", discover.format_of(F.col("path"))).filter(F.col("kind").isNotNull())


def extracted(stream: DataFrame) -> DataFrame:
    """Pages of arriving files, read by the same readers as in batch."""
    return formats.extract(stream)


def write_extracted(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append extracted documents; each file once, whatever fails meanwhile."""
    return extracted(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(rows: DataFrame) -> DataFrame:
    """ts as a timestamp: a watermark takes no other type."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def conversation_days(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages per conversation and day, closed once the watermark has passed.
    messages: ts, conversation, sender."""
    day = F.window("ts", "1 day")
    counts = _timed(messages).withWatermark("ts", late).groupBy(day.alias("w"), "conversation").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("sender")).alias("people"))
    return counts.select("conversation", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "people")


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts and sums of events; later events are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row per user and session: a session ends after a gap without events."""
    return _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def refresh(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call a rebuild with each batch of changes, such as the global index's."""
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
