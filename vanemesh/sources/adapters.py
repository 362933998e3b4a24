"""The driver tables seen as stations and observations, with the same views as SQL for the oracle.

Averages are taken over integer hundredths, so both engines get the very same doubles.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TimeRange

EVENT_VARIABLES = {"click": "temp_out", "view": "out_hum", "purchase": "wind_speed", "signup": "bar", "error": "rain"}
AS_OF = datetime(2024, 1, 31)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def hundredths(c: str) -> Column:
    return F.floor(F.col(c) * 100 + 0.5).cast("long")


def events_long(spark: SparkSession, sf: str) -> DataFrame:
    """Users as stations, event types as variables, one reading per event."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("station_id"), ntz(F.col("ts")).alias("time"),
        F.col("event_type").alias("variable"), "value")


EVENTS_LONG = """events_long AS (
  SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS time, event_type AS variable, value FROM events)"""


def hourly(spark: SparkSession, sf: str, span: TimeRange | None = None) -> DataFrame:
    """14 stations with one row per hour; variables without an event in the hour are NULL.

    With ``span`` only the events that its hours can hold are read: the scan skips the others.
    """
    e = table(spark, sf, "events")
    if span is not None:
        e = e.where((F.col("ts") >= F.lit(span.start)) & (F.col("ts") < F.lit(span.end + timedelta(hours=1))))
    e = e.withColumn("v", hundredths("value"))

    def mean(kind):
        v = F.when(F.col("event_type") == kind, F.col("v"))
        return (F.sum(v) / F.count(v) / 100.0).alias(EVENT_VARIABLES[kind])

    return e.groupBy(
        (F.col("user_id") % 14).cast("string").alias("station_id"), ntz(F.date_trunc("hour", "ts")).alias("time")
    ).agg(*[mean(k) for k in EVENT_VARIABLES])


HOURLY = """hourly AS (
  SELECT CAST(user_id % 14 AS VARCHAR) AS station_id, date_trunc('hour', ts) AS time, """ + ", ".join(
    f"SUM(CASE WHEN event_type = '{k}' THEN v END) / COUNT(CASE WHEN event_type = '{k}' THEN v END) / 100.0::DOUBLE AS {n}"
    for k, n in EVENT_VARIABLES.items()
) + """
  FROM (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events) GROUP BY 1, 2)"""


def supplier_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as stations with one row per week that has a shipment: two totals and two means."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("station_id"), ntz(F.date_trunc("week", "l_shipdate")).alias("time"),
        F.col("l_quantity").cast("long").alias("q"), hundredths("l_extendedprice").alias("p"),
        hundredths("l_discount").alias("d"), hundredths("l_tax").alias("t"))
    n = F.count(F.lit(1))
    return items.groupBy("station_id", "time").agg(
        (F.sum("p") / 100000.0).alias("temp_out"), (F.sum("d") / n).alias("out_hum"),
        F.sum("q").cast("double").alias("wind_speed"), (F.sum("t") / n).alias("bar"))


SUPPLIER_OBS = """supplier_obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS station_id, date_trunc('week', l_shipdate) AS time,
    SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) / 100000.0::DOUBLE AS temp_out,
    SUM(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) / COUNT(*) AS out_hum,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS wind_speed,
    SUM(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) / COUNT(*) AS bar
  FROM lineitem GROUP BY 1, 2)"""


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as stations on an invented map of 6 by 8 degrees."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").join(
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    return s.select(
        k.cast("string").alias("station_id"), F.col("s_name").alias("station_name_en"),
        F.col("n_name").alias("country"), (35 + k * 37 % 600 / 100.0).alias("latitude"),
        (20 + k * 53 % 800 / 100.0).alias("longitude"), (k * 91 % 1200).cast("double").alias("elevation"))


STATIONS = """stations AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name_en, n_name AS country,
    35 + (s_suppkey * 37 % 600) / 100.0::DOUBLE AS latitude, 20 + (s_suppkey * 53 % 800) / 100.0::DOUBLE AS longitude,
    CAST(s_suppkey * 91 % 1200 AS DOUBLE) AS elevation
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def hourly_stations(spark: SparkSession, sf: str) -> DataFrame:
    """The 14 stations of ``hourly``, taken from the users that occur."""
    k = F.col("k")
    users = table(spark, sf, "events").select((F.col("user_id") % 14).alias("k")).distinct()
    return users.select(
        k.cast("string").alias("station_id"), F.concat(F.lit("Station "), k).alias("station_name_en"),
        (38 + k * 3 % 14 / 10.0).alias("latitude"), (22 + k * 5 % 14 / 10.0).alias("longitude"),
        (k * 67 % 700).cast("double").alias("elevation"))


HOURLY_STATIONS = """hourly_stations AS (
  SELECT CAST(k AS VARCHAR) AS station_id, 'Station ' || k AS station_name_en,
    38 + (k * 3 % 14) / 10.0::DOUBLE AS latitude, 22 + (k * 5 % 14) / 10.0::DOUBLE AS longitude,
    CAST(k * 67 % 700 AS DOUBLE) AS elevation
  FROM (SELECT DISTINCT user_id % 14 AS k FROM events))"""


def geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Events as snapshots of one feature each. Every 17th lacks ``station_file``, every 19th has no time."""
    return table(spark, sf, "events").select("event_id", snapshot_text().alias("value"))


def snapshot_text() -> Column:
    user = F.col("user_id").cast("string")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    properties = F.struct(
        F.when(F.col("event_id") % 17 != 0, user).alias("station_file"), F.concat(F.lit("f"), user).alias("fid"),
        F.concat_ws("-", F.lit("s"), user, F.col("event_id") % 3).alias("station_name_en"),
        F.when(F.col("event_id") % 19 == 0, 0).otherwise(seconds).alias("ts"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("temp_out"),
        F.get_json_object("props", "$.k").cast("double").alias("rain"))
    place = F.array(F.lit(20.0) + F.col("user_id") % 80 / 10.0, F.lit(35.0) + F.col("user_id") % 60 / 10.0)
    coordinates = F.when(F.col("user_id") % 2 == 0, F.concat(place, F.array((F.col("user_id") % 900).cast("double")))
                         ).otherwise(place)
    return F.to_json(F.struct(F.array(F.struct(
        properties.alias("properties"), F.struct(coordinates.alias("coordinates")).alias("geometry"))).alias("features")))


FEATURES = """features AS (
  SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'f' || user_id END AS station_id,
    's-' || user_id || '-' || event_id % 3 AS station_name_en,
    CASE WHEN event_id % 19 = 0 THEN 0 ELSE CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS ts,
    CASE WHEN event_type <> 'error' THEN value END AS temp_out,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rain,
    35.0::DOUBLE + (user_id % 60) / 10.0::DOUBLE AS latitude, 20.0::DOUBLE + (user_id % 80) / 10.0::DOUBLE AS longitude,
    CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 900 AS DOUBLE) END AS elevation
  FROM events)"""


def long_sql(source: str, name: str = "long", variables=("temp_out", "out_hum", "wind_speed", "bar")) -> str:
    parts = " UNION ALL ".join(f"SELECT station_id, time, '{v}' AS variable, {v} AS value FROM {source}" for v in variables)
    return f"{name} AS ({parts})"


def edges_sql(stations_name: str = "stations", name: str = "edges", max_km: float = 100, max_elev: float = 500) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT a.station_id AS src, b.station_id AS dst,
      2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2)
        + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2)))) AS dist_km,
      b.elevation - a.elevation AS elev_diff
    FROM {stations_name} a JOIN {stations_name} b ON a.station_id <> b.station_id
    WHERE abs(a.elevation - b.elevation) <= {max_elev})
  WHERE dist_km <= {max_km})"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
