"""Table views: latest rows, snapshots, summaries, joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import seconds
from .scale import time_parts, with_index


def latest(obs: DataFrame, n: int = 20) -> DataFrame:
    return obs.orderBy(F.desc("time"), "station_id").limit(n)


def latest_per_station(obs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` rows of every station; Spark keeps n rows per task before it shuffles."""
    order = Window.partitionBy("station_id").orderBy(F.desc("time"))
    return obs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).withColumn(
        "epoch", F.floor(seconds("time")).cast("long"))


def snapshot(obs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The rows at the newest time of the table."""
    upto = obs if as_of is None else obs.where(F.col("time") <= as_of)
    newest = upto.agg(F.max("time").alias("time"))
    return obs.join(F.broadcast(newest), "time", "left_semi")


def latest_values(long: DataFrame) -> DataFrame:
    """Each series' newest reading."""
    present = long.where(F.col("value").isNotNull())
    return present.groupBy("station_id", "variable").agg(
        F.max("time").alias("time"), F.max_by("value", "time").alias("value"))


def table_summary(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("station_id").alias("station_count"),
                   F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def station_summary(obs: DataFrame) -> DataFrame:
    return obs.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def with_station(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows with their station's columns; rows of unknown stations stay."""
    return obs.join(stations, "station_id", "left")


def newest_first(rows: DataFrame) -> DataFrame:
    """``rows`` in order, the latest time first, then by station, rows without a time last; adds ``position``, from 1.

    Positions are counted inside parts of time and offset by the parts before, so no task sees all rows.
    """
    part = F.coalesce(-time_parts(rows, []), F.lit(2**62))
    order = [F.desc_nulls_last("time"), F.asc("station_id")]
    return with_index(rows, [], order, part, "position").withColumn("position", F.col("position") + 1).orderBy("position")


def network_centre(stations: DataFrame) -> DataFrame:
    return stations.agg(F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"),
                        F.count(F.lit(1)).alias("station_count"))
