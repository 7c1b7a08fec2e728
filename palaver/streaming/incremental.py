"""Continuous forms: new transcript files as they appear, and windows over events.  Extensions, with the semantics of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palaver.sources import ingest

_FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, root: str, extension: str, sink: Callable[[DataFrame, int], None], checkpoint: str, provider: str | None = None) -> StreamingQuery:
    """Parse files that appear below a folder; ``sink`` gets the events of each batch with its number, so a repeated batch can be told."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").option("maxFilesPerTrigger", 1000).load(root)
    snap = files.select(F.col("path").alias("source_path"), F.col("length").alias("len_bytes"), "content", F.sha2("content", 256).alias("fingerprint"), F.lit(provider).cast("string").alias("provider_id"))
    return snap.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(ingest.parse_files(batch), n)).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type and window of time; rows later than the watermark are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events without a pause longer than ``gap`` are one session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
