"""GeoJSON snapshots: parsing into observation and station rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of a snapshot.
READINGS = (
    "temp_out double, hi_temp double, low_temp double, out_hum double, bar double, rain double, "
    "wind_speed double, wind_dir double, wind_dir_str string, hi_speed double, hi_dir double, hi_dir_str string"
)
PROPERTIES = (
    "station_file string, fid string, station_name_en string, station_name_gr string, ts bigint, " + READINGS
)
SNAPSHOT = (
    f"features array<struct<properties: struct<{PROPERTIES.replace(' double', ': double').replace(' string', ': string').replace(' bigint', ': bigint')}>, "
    "geometry: struct<coordinates: array<double>>>>"
)
READING_NAMES = tuple(part.split()[0] for part in READINGS.split(", "))


def features(snapshots: DataFrame, value: str = "value") -> DataFrame:
    """One row per feature with a key. Unreadable snapshots give no rows; see ``unreadable``.

    The key is ``station_file``; ``fid`` stands in for a missing or empty one.
    """
    others = [c for c in snapshots.columns if c != value]
    parsed = snapshots.select(*others, F.from_json(value, SNAPSHOT).alias("doc"))
    rows = parsed.select(*others, F.posexplode("doc.features").alias("feature_no", "f"))
    key = F.coalesce(F.nullif(F.col("f.properties.station_file"), F.lit("")), F.nullif(F.col("f.properties.fid"), F.lit("")))
    return rows.withColumn("station_id", key).where(F.col("station_id").isNotNull())


def unreadable(value: str = "value") -> Column:
    """True for a snapshot without a readable feature list."""
    return F.from_json(value, SNAPSHOT)["features"].isNull()


def observations(feature_rows: DataFrame) -> DataFrame:
    """Features with a positive time stamp; the other columns of the input stay."""
    others = [c for c in feature_rows.columns if c not in ("f", "station_id")]
    p = F.col("f.properties")
    return feature_rows.where(p["ts"] > 0).select(
        F.timestamp_seconds(p["ts"]).alias("time"), "station_id", *[p[c].alias(c) for c in READING_NAMES], *others)


def stations(feature_rows: DataFrame) -> DataFrame:
    """Every feature's station, also of those without a time stamp."""
    others = [c for c in feature_rows.columns if c not in ("f", "station_id")]
    p, xy = F.col("f.properties"), F.col("f.geometry.coordinates")
    return feature_rows.select(
        "station_id", p["station_name_en"].alias("station_name_en"), p["station_name_gr"].alias("station_name_gr"),
        F.get(xy, F.lit(1)).alias("latitude"), F.get(xy, F.lit(0)).alias("longitude"),
        F.get(xy, F.lit(2)).alias("elevation"), *others)
