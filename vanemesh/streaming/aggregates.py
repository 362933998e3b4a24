"""Streaming rollups, sliding statistics, profiles and bounded-state deduplication.

Event times must be TIMESTAMP for a watermark, so time columns without a zone are cast (session zone UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import quick_stats


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)


def dedupe(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Drops repeated ``(time, station_id)`` while their state lasts; exact storage is left to the ingest."""
    return _timed(stream, delay).dropDuplicatesWithinWatermark(["time", "station_id"])


def hourly(stream: DataFrame, value: str = "value", delay: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """The continuous hourly aggregate; a window closes once the watermark passes it."""
    return _timed(stream, delay).groupBy(F.window("time", width).alias("w"), "station_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.stddev_samp(value).alias("std_value"))


def sliding(stream: DataFrame, keys=("station_id", "variable"), width: str = "6 hours", step: str = "10 minutes",
            delay: str = "2 hours") -> DataFrame:
    """Statistics of every sliding window, the stream form of asking again for the last hours."""
    return _timed(stream, delay).groupBy(F.window("time", width, step).alias("w"), *keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def profile(stream: DataFrame, width: str = "24 hours", step: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """The quick profile per sliding window, station and variable."""
    return _timed(stream, delay).groupBy(F.window("time", width, step).alias("w"), "station_id", "variable").agg(
        *quick_stats())


def save_updates(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the changed groups of each micro-batch to its own folder, safe to repeat."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every group from the saved updates."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_s")).select(*keys, "_s.*")
