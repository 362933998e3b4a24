"""Storing snapshots: first write wins per reading, last write wins per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("time", "station_id")
STATION_VALUES = ("station_name_en", "station_name_gr", "latitude", "longitude", "elevation")
# The reduced update of the second store: other columns keep their first value.
REDUCED_VALUES = ("station_name_en", "latitude", "longitude")


def first_writes(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row of each ``(time, station_id)``. Copies merge before the shuffle, however many."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*KEY, "_r.*")


def new_rows(rows: DataFrame, stored: DataFrame, order: Sequence[str]) -> DataFrame:
    """First writes that the table does not hold yet."""
    return first_writes(rows, order).join(stored.select(*KEY), [*KEY], "left_anti")


def station_updates(seen: DataFrame, seen_at: str, order: Sequence[str]) -> DataFrame:
    """One row per station of a batch: last values, first values, first and last sighting."""
    values = F.struct(*STATION_VALUES)
    return seen.groupBy("station_id").agg(
        F.max_by(values, F.struct(*order)).alias("newest"), F.min_by(values, F.struct(*order)).alias("oldest"),
        F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen"))


def upsert_stations(stored: DataFrame, seen: DataFrame, seen_at: str, order: Sequence[str],
                    updated: Sequence[str] = STATION_VALUES) -> DataFrame:
    """Merge a batch into the station table: values replaced, ``first_seen`` kept, ``last_seen`` moved.

    Columns outside ``updated`` are only set when a station is new.
    """
    batch = station_updates(seen, seen_at, order).withColumnsRenamed(
        {"first_seen": "_first", "last_seen": "_last"})
    known = F.col("_known").isNotNull()
    joined = stored.withColumn("_known", F.lit(True)).join(batch, "station_id", "full_outer")
    values = []
    for c in STATION_VALUES:
        incoming = F.col(f"newest.{c}") if c in updated else F.col(f"oldest.{c}")
        if c in updated:
            values.append(F.when(F.col("newest").isNotNull(), incoming).otherwise(F.col(c)).alias(c))
        else:
            values.append(F.when(known, F.col(c)).otherwise(incoming).alias(c))
    return joined.select(
        "station_id", *values, F.coalesce("first_seen", "_first").alias("first_seen"),
        F.greatest(F.coalesce("last_seen", "_last"), F.coalesce("_last", "last_seen")).alias("last_seen"))


def log_rows(features_seen: DataFrame, stored_rows: DataFrame, batch: str) -> DataFrame:
    """One audit row per batch: stations seen and new observations, with the message."""
    s = features_seen.groupBy(batch).agg(F.count(F.lit(1)).alias("stations_count"))
    o = stored_rows.groupBy(batch).agg(F.count(F.lit(1)).alias("observations_count"))
    joined = s.join(o, batch, "left").fillna(0, ["observations_count"])
    return joined.withColumn("status", F.lit("SUCCESS")).withColumn("message", F.concat(
        F.lit("Stored "), F.col("observations_count"), F.lit(" obs from "), F.col("stations_count"), F.lit(" stations")))
