"""Continuous ingest of landed snapshots into deduplicated tables.

Observations are stored by day, and in a day by run (the id that Spark keeps in the checkpoint) and batch. A batch
replaces its own folders only, so it can be run again, and an ingest with a new checkpoint adds to what is stored.
Exactness does not depend on a horizon: a batch drops what all other batches hold of its days. ``Store.compact`` merges the folders of
many batches; all readers follow its manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..operators.scale import settle
from ..sources import geojson
from . import compaction

# The tables of a store, and whether they have a folder for each day. The log is the last that a batch writes.
TABLES = {"observations": True, "stations": False, "log": False}
SNAPSHOT = "value string, landed_at timestamp, source string"


@dataclass(frozen=True)
class Store:
    """The folder of the observation, station and log tables."""

    folder: str

    def table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def schemas(self, spark: SparkSession) -> dict[str, T.StructType]:
        """The tables' columns, with the run and batch of each row."""
        batch = spark.createDataFrame([], SNAPSHOT)
        rows = geojson.features(batch)
        fresh = geojson.observations(rows).drop("feature_no").withColumn("obs_date", F.to_date("time"))
        tables = {
            "observations": fresh.drop("source"), "log": snapshot_log(batch, rows, fresh),
            "stations": ingest.station_updates(geojson.stations(rows), "landed_at", ["landed_at"])}
        own = [T.StructField("run", T.StringType()), T.StructField("batch_id", T.IntegerType())]
        return {name: T.StructType([*df.schema.fields, *own]) for name, df in tables.items()}

    def rows(self, spark: SparkSession, name: str) -> DataFrame:
        return compaction.rows(spark, self.folder, name, self.schemas(spark)[name], TABLES[name])

    def compact(self, spark: SparkSession, least: int = 2) -> compaction.Manifest:
        """Merge what ``least`` or more batches have stored of a day, and all batches' updates of the stations."""
        done = compaction.finished(compaction.Files(spark, self.folder), self.folder, "log")
        return compaction.compact(spark, self.folder, TABLES, done, self.schemas(spark), {"stations": merged_stations}, least)

    def observations(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark, "observations").drop("run", "batch_id")

    def stations(self, spark: SparkSession) -> DataFrame:
        """The current station table, merged from the batches' updates."""
        rows = self.rows(spark, "stations")
        return rows.groupBy("station_id").agg(
            F.max_by("newest", F.struct("last_seen", "batch_id")).alias("v"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen")).select("station_id", "v.*", "first_seen", "last_seen")

    def log(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark, "log")


def merged_stations(rows: DataFrame) -> DataFrame:
    """One row per station that says the same as its updates."""
    order = F.struct("last_seen", "batch_id")
    return rows.groupBy("station_id").agg(
        F.max_by("newest", order).alias("newest"), F.min_by("oldest", F.struct("first_seen", "batch_id")).alias("oldest"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("run", order).alias("run"),
        F.max_by("batch_id", order).alias("batch_id"))


def snapshot_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Landed snapshot files, one document each, with the time they landed."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(
        "value", F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("source"))


def start_ingest(snapshots: DataFrame, store: Store, checkpoint: str, order=("landed_at", "source", "feature_no"),
                 every: str | None = None) -> StreamingQuery:
    """``every`` is the trigger interval (``10 minutes`` is the usual cadence); None ingests what has landed."""

    spark = snapshots.sparkSession
    run: list[str] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        if not run:
            run.append(spark.read.json(f"{checkpoint}/metadata").first()["id"])
        batch = batch.persist()
        try:
            _save_batch(spark, batch, run[0], batch_id, store, list(order))
        finally:
            batch.unpersist()

    writer = snapshots.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _save_batch(spark: SparkSession, batch: DataFrame, run: str, batch_id: int, store: Store, order: list[str]) -> None:
    rows = geojson.features(batch)
    target = store.table("observations")
    fresh = ingest.first_writes(geojson.observations(rows), order).drop("feature_no").withColumn("obs_date", F.to_date("time"))
    here = [F.lit(run).alias("run"), F.lit(batch_id).alias("batch_id")]
    kept = fresh.drop("source")
    # The table exists from here on, also if the batch has no rows.
    by_day = {"partitionBy": ["obs_date", "run", "batch_id"]}
    kept.select("*", *here).limit(0).write.mode("append").parquet(target, **by_day)
    days = F.broadcast(fresh.select("obs_date").distinct())  # one row a day; it prunes the folders that are read
    others = store.rows(spark, "observations").where((F.col("run") != run) | (F.col("batch_id") != batch_id))
    held = others.join(days, "obs_date", "left_semi").select("time", "station_id", "obs_date")
    fresh = settle(fresh.join(held, ["time", "station_id", "obs_date"], "left_anti"), "fresh")
    fresh.drop("source").select("*", *here).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(target, **by_day)
    folder = f"run={run}/batch_id={batch_id}"
    ingest.station_updates(geojson.stations(rows), "landed_at", order).write.mode("overwrite").parquet(
        f"{store.table('stations')}/{folder}")
    snapshot_log(batch, rows, fresh).write.mode("overwrite").parquet(f"{store.table('log')}/{folder}")


def snapshot_log(batch: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """A row for each snapshot: SUCCESS with what was stored of it, or ERROR. An empty feature list gives none."""
    key = ["landed_at", "source"]
    seen = rows.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("stations_count"))
    stored = fresh.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("observations_count"))
    good = seen.join(stored, key, "left").fillna(0, ["observations_count"]).select(
        F.lit("SUCCESS").alias("status"), "stations_count", "observations_count", F.format_string(
            STORED, "observations_count", "stations_count").alias("message"), F.col("landed_at").alias("timestamp"))
    bad = batch.where(geojson.unreadable()).select(
        F.lit("ERROR").alias("status"), F.lit(0).alias("stations_count"), F.lit(0).alias("observations_count"),
        F.lit("Error: unreadable snapshot").alias("message"), F.col("landed_at").alias("timestamp"))
    return good.unionByName(bad)


# Fixed value: the message of the collection log.
STORED = "Stored %d obs from %d stations"
