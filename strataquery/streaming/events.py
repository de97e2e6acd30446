"""Event-time operators and continuous refresh, by Structured Streaming.

Each operator is a function of a DataFrame, so the same code runs over a
stream and, for checking, over a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: str | StructType, *, files_per_trigger: int = 64) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(rows: DataFrame, at: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone; event times are UTC."""
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def late(rows: DataFrame, delay: str, at: str = "ts") -> DataFrame:
    """Allow rows to be ``delay`` late; only streams have a watermark."""
    return rows.withWatermark(at, delay) if rows.isStreaming else rows


def tumbling(rows: DataFrame, size: str, *, delay: str = "1 hour", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Rows and summed value of each window and group."""
    grouped = late(timed(rows, at), delay, at).groupBy(F.window(at, size), by)
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "events", "total")


def sliding(rows: DataFrame, size: str, step: str, *, delay: str = "1 hour", at: str = "ts") -> DataFrame:
    return late(timed(rows, at), delay, at).groupBy(F.window(at, size, step)).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "events")


def sessions(rows: DataFrame, gap: str, *, delay: str = "1 hour", at: str = "ts", by: str = "user_id") -> DataFrame:
    """Start, end and rows of each run of a key's rows without a longer pause than ``gap``."""
    grouped = late(timed(rows, at), delay, at).groupBy(F.session_window(at, gap), by)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def distinct(rows: DataFrame, keys: list[str], *, delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """The first of rows with equal keys; a stream forgets keys once the watermark passes them."""
    timed_rows = late(timed(rows, at), delay, at)
    return timed_rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else timed_rows.dropDuplicates(keys)


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, interval: str | None = None):
    """Run ``apply`` on every micro-batch: events that pile up meanwhile become one batch.

    With an interval the query goes on, without one it ends when all present
    files are done. ``apply`` must be idempotent for a batch id, as a batch is
    repeated after a failure.
    """
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
