"""Observation and station tables: schemas, scans, unpivot, file formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DETECTED, RAIN, VARIABLES, WIND_DIR, TimeRange, VariableConfig
from ..functions.columns import clean

# The columns of the three tables.
STATIONS = (
    "station_id string, station_name_en string, station_name_gr string, latitude double, "
    "longitude double, elevation double, first_seen timestamp, last_seen timestamp"
)
OBSERVATIONS = (
    "time timestamp, station_id string, temp_out double, hi_temp double, low_temp double, "
    "out_hum double, bar double, rain double, wind_speed double, wind_dir double, wind_dir_str string, "
    "hi_speed double, hi_dir double, hi_dir_str string, collected_at timestamp"
)
COLLECTION_LOG = (
    "id long, timestamp timestamp, status string, stations_count int, observations_count int, message string"
)


def read_csv(spark: SparkSession, path: str, schema: str = OBSERVATIONS) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_jdbc(spark: SparkSession, url: str, table: str, days: Sequence[str], **options: str) -> DataFrame:
    """One partition per day, so that a long range is read by many tasks."""
    predicates = [f"time >= '{a}' AND time < '{b}'" for a, b in zip(days, days[1:])]
    return spark.read.jdbc(url, table, predicates=predicates, properties=dict(options))


def write_observations(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day, rows sorted so that row groups can be skipped by station and time."""
    (
        df.withColumn("obs_date", F.to_date("time"))
        .repartition("obs_date", F.pmod(F.xxhash64("station_id"), F.lit(16)))
        .sortWithinPartitions("obs_date", "station_id", "time")
        .write.mode(mode).partitionBy("obs_date").parquet(path)
    )


def read_observations(spark: SparkSession, path: str, span: TimeRange | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if span is not None:
        df = df.where(F.col("obs_date").between(span.start.date(), span.end.date())).where(span.contains())
    return df


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scan(obs: DataFrame, span: TimeRange | None = None, stations: Sequence[str] | None = None,
         exclude: Sequence[str] | None = None, variables: Sequence[str] = (*DETECTED, "rain")) -> DataFrame:
    """The window of a wide table; absent variables are left out."""
    if span is not None:
        obs = obs.where(span.contains())
    if stations is not None:
        obs = obs.where(F.col("station_id").isin(*stations))
    if exclude:
        obs = obs.where(~F.col("station_id").isin(*exclude))
    present = [v for v in variables if v in obs.columns]
    return obs.select("station_id", "time", *present)


def labelled(rows: DataFrame, configs: Sequence[VariableConfig] = (*VARIABLES, RAIN, WIND_DIR)) -> DataFrame:
    """Adds the label and the unit of each row's ``variable``."""

    def named(attribute: str) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for c in configs for x in (c.name, getattr(c, attribute))]), F.col("variable"))

    return rows.withColumns({"label": named("label"), "unit": named("unit")})


def retained(obs: DataFrame, as_of: Column, years: int = 1) -> DataFrame:
    """Rows of the last years, as a filter."""
    return obs.where(F.col("time") >= as_of - F.make_ym_interval(F.lit(years), F.lit(0)))


def long_form(obs: DataFrame, variables: Sequence[str] = DETECTED) -> DataFrame:
    """One row per station, time and variable; NaN values become NULL."""
    present = [v for v in variables if v in obs.columns]
    # Not ``unpivot``: expressions shared over its output do not compile in Spark 4.1.
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), clean(v).alias("value")) for v in present])
    return obs.select("station_id", "time", F.inline(pairs))


def station_overrides(stations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply an override table with an ``enabled`` flag to the station table."""
    columns = [c for c in overrides.columns if c not in ("station_id", "enabled")]
    renamed = overrides.select("station_id", "enabled", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stations.join(renamed, "station_id", "left").where(F.coalesce("enabled", F.lit(True)))
    merged = [F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stations.columns]
    return joined.select(*merged)


def struct_fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields
