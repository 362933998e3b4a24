"""Late readings on a stream: told from the others by a watermark in the state, kept, and counted per window.

A station's watermark is the latest time that it has sent so far, less ``delay``. A reading is late when its time lies before the
watermark of the readings that arrived before it. Late readings do not disappear: each micro-batch writes those in time and the late
ones to tables of their own, with the watermark that judged them.

The state is a small table of marks, one row a station, written with each micro-batch and read by the next. A batch that is repeated
replaces its own folders and finds the marks of the batch before it, so no reading is lost or counted twice. Arrival is told by the
columns ``order``; inside a batch the running maximum is carried over parts of that order, so that one station's readings need not
meet in one task.

Readings without a time or station belong nowhere on the time axis: they are late with no watermark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.columns import micros
from ..operators.scale import carry_parts, settle

# Arrivals of one station in a part.
PART_ROWS = 200_000


@dataclass(frozen=True)
class Split:
    """The folder of the tables ``in_time``, ``late`` and ``marks``, each with a folder per micro-batch."""

    folder: str

    def table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def in_time(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.table("in_time")).drop("batch_id")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.table("late")).drop("batch_id")


def judged(rows: DataFrame, marks: DataFrame | None, delay_seconds: float, order: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` (station_id, time, ``order``: whole numbers that rise with arrival) with ``watermark``, null for a station's first
    reading, and ``late``. ``marks`` holds the latest time of each station before these rows."""
    placed = F.col("time").isNotNull() & F.col("station_id").isNotNull()
    known = rows.where(placed)
    low, high, n = known.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    width = max(1, int((high - low + 1) * part_rows / n)) if n else 1
    parts = known.withColumn("_part", F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)).cast("long"))
    before = carry_parts(parts, ["station_id"], "_part", [F.max("time").alias("_latest")],
                         {"_carried": lambda w: F.max("_latest").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    if marks is not None:
        before = before.join(marks.select("station_id", F.col("latest").alias("_mark")), "station_id", "left")
    else:
        before = before.withColumn("_mark", F.lit(None).cast(rows.schema["time"].dataType))
    inside = Window.partitionBy("station_id", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.greatest("_mark", "_carried", F.max("time").over(inside))
    found = before.withColumn("watermark", _earlier(latest, delay_seconds))
    told = found.withColumn("late", F.coalesce(F.col("time") < F.col("watermark"), F.lit(False))).drop("_part", "_carried", "_mark")
    lost = rows.where(~placed).withColumns({"watermark": F.lit(None).cast(told.schema["watermark"].dataType), "late": F.lit(True)})
    return told.unionByName(lost)


def _earlier(time: Column, seconds: float) -> Column:
    return time - F.make_dt_interval(secs=F.lit(float(seconds)))


def start_split(readings: DataFrame, split: Split, checkpoint: str, delay_seconds: float, order: str, every: str | None = None) -> StreamingQuery:
    """Split ``readings`` (station_id, time, ``order`` and more) as they arrive; ``order`` must rise from batch to batch."""
    spark = readings.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        marks = None
        if batch_id:
            marks = spark.read.parquet(f"{split.table('marks')}/batch_id={batch_id - 1}")
        found = settle(judged(settle(batch, "batch"), marks, delay_seconds, order), "judged")
        for name, rows in (("in_time", found.where(~F.col("late"))), ("late", found.where("late"))):
            rows.drop("late").write.mode("overwrite").parquet(f"{split.table(name)}/batch_id={batch_id}")
        newest = found.where(F.col("station_id").isNotNull()).groupBy("station_id").agg(F.max("time").alias("latest"))
        if marks is not None:
            newest = marks.unionByName(newest).groupBy("station_id").agg(F.max("latest").alias("latest"))
        newest.write.mode("overwrite").parquet(f"{split.table('marks')}/batch_id={batch_id}")

    writer = readings.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def late_counts(in_time: DataFrame, late: DataFrame, width: str = "1 hour", keys=("station_id",)) -> DataFrame:
    """Per window and station: readings in time and late, and by how many seconds the latest of them missed its watermark. Windows that
    only late readings fall in have a row too; readings without a time have a row without a window."""
    by = [F.window("time", width).alias("w"), *keys]
    behind = (micros("watermark") - micros("time")) / 1_000_000

    def counted(rows: DataFrame, is_late: int) -> DataFrame:
        timed = rows.where(F.col("time").isNotNull()).groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.max(behind).alias("behind")).select(F.col("w.start").alias("bucket"), *keys, "n", "behind")
        kind = timed.schema["bucket"].dataType
        rest = rows.where(F.col("time").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("behind"))
        return timed.unionByName(rest.withColumn("bucket", F.lit(None).cast(kind))).withColumn("late", F.lit(is_late))

    both = counted(in_time, 0).unionByName(counted(late, 1))
    return both.groupBy("bucket", *keys).agg(
        F.sum(F.when(F.col("late") == 0, F.col("n")).otherwise(0)).alias("in_time"),
        F.sum(F.when(F.col("late") == 1, F.col("n")).otherwise(0)).alias("late"),
        F.max(F.when(F.col("late") == 1, F.col("behind"))).alias("most_behind"))
