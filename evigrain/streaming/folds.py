"""Streams: append-only capture read as a stream, events folded by user and event time, idempotent batches.

Event-time windows and watermarks are an extension: the capture format itself only appends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def captured(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of JSON lines as a stream; the limit on files per trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def folded_events(events: DataFrame, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Count, value and kinds of events by user and window. On a stream, `late` bounds the state."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.array_sort(F.collect_set("event_type")).alias("kinds")).select("user_id", F.col("w.start").alias("start"), "n", "value", "kinds")


def coalesced_jobs(jobs: DataFrame) -> DataFrame:
    """Queued jobs of one target as one: forced if any is, with their distinct reasons."""
    return jobs.groupBy("target").agg(F.bool_or("force").alias("force"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.count("*").alias("jobs"))


def once_per_batch(write: Callable[[DataFrame, str], None], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a place of its own, so that a repeated batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        write(batch, f"{folder}/batch={number}")

    return run
