"""Streaming ingestion, windows and caches with expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import parent_child_chunks


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Stored times carry no zone, which watermarks do not take; in a stream they count as UTC, whatever the session's zone."""
    if dict(events.dtypes)[column] != "timestamp_ntz" or not events.isStreaming:
        return events
    return events.withColumn(column, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, for batches and streams."""
    e = event_time(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = event_time(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def ingest(stream: DataFrame, target: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame] = parent_child_chunks):
    """Appends the chunks of new documents; a batch that is run again overwrites its own folder, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_key(events: DataFrame, ttl: str = "1 hour"):
    """Keeps the first answer per key while it is fresh, as a stream with a bounded state."""
    e = event_time(events).withWatermark("ts", ttl)
    return e.dropDuplicatesWithinWatermark(["event_type", "user_id"])
