"""Long-term sensor health, completeness, freshness and collector health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import OBSERVATIONS_PER_DAY, VARIABLES, VariableConfig, per_variable
from ..functions.columns import fixed_text, percent_text, seconds
from .scale import carry_parts

ZERO_LIMIT, NULL_LIMIT, VARIANCE_LIMIT = 0.3, 0.5, 0.1


def variable_health(long: DataFrame, zero_limit: float = ZERO_LIMIT, null_limit: float = NULL_LIMIT,
                    variance_limit: float = VARIANCE_LIMIT) -> DataFrame:
    """Zero ratio, missing ratio and sample variance per station and variable, with the issues found."""
    out = ratios(long)
    zero, null, var = F.col("zero_ratio"), F.col("null_ratio"), F.col("variance")
    # The wording of the issues.
    issues = F.array_compact(F.array(
        F.when(zero > zero_limit, F.concat(
            F.lit("High zero ratio ("), percent_text(zero), F.lit(") - sensor may be stalled"))),
        F.when(null > null_limit, F.concat(F.lit("High missing rate ("), percent_text(null), F.lit(")"))),
        F.when((var < variance_limit) & (null < 0.9), F.concat(
            F.lit("Low variance ("), fixed_text(var, 3), F.lit(") - sensor may be stuck"))),
    ))
    return out.withColumn("issues", issues).withColumn(
        "severity", F.when(F.size("issues") > 0, "critical").otherwise("healthy"))


def ratios(long: DataFrame, keys: Sequence[str] = ("station_id", "variable")) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"), F.count("value").alias("n"),
        F.count_if(F.col("value") == 0).alias("zeros"), F.var_samp("value").alias("variance"),
    ).select(
        *keys, "data_points", (F.col("zeros") / F.col("data_points")).alias("zero_ratio"),
        ((F.col("data_points") - F.col("n")) / F.col("data_points")).alias("null_ratio"),
        F.coalesce(F.when(F.col("n") > 1, F.col("variance")), F.lit(0.0)).alias("variance"),
    )


def station_health(long: DataFrame, stations: DataFrame, days: float = 30,
                   per_day: int = OBSERVATIONS_PER_DAY, rows: DataFrame | None = None) -> DataFrame:
    """One row per station: completeness, status (critical when a variable is), issues; or ``no_data``.

    ``rows`` brings the rows to count where ``long`` has only some variables of a station.
    """
    health = variable_health(long)
    per_station = health.groupBy("station_id").agg(
        F.max("data_points").alias("data_points"),
        F.max((F.col("severity") == "critical").cast("int")).alias("_critical"),
        F.sum(F.size("issues")).alias("issue_count"))
    if rows is not None:
        counted = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("data_points"))
        per_station = counted.join(per_station.drop("data_points"), "station_id", "left").fillna(0, ["_critical", "issue_count"])
    completeness = F.col("data_points") / F.lit(float(days * per_day))
    status = F.when(F.col("_critical").isNull(), "no_data").when(F.col("_critical") == 1, "critical").otherwise("healthy")
    return stations.select("station_id").join(per_station, "station_id", "left").select(
        "station_id", F.lit(days).alias("days"), F.coalesce("data_points", F.lit(0)).alias("data_points"),
        completeness.alias("data_completeness"), status.alias("overall_status"),
        F.coalesce("issue_count", F.lit(0)).alias("issue_count"))


def graded_health(long: DataFrame, configs: Sequence[VariableConfig] = VARIABLES) -> DataFrame:
    """Three levels per metric and variable; the worst metric gives the severity."""
    out = ratios(long).withColumn("_floor", F.coalesce(per_variable("variance_floor", configs), F.lit(VARIANCE_LIMIT)))
    zero = F.when(F.col("zero_ratio") > 0.5, 2).when(F.col("zero_ratio") > 0.3, 1).otherwise(0)
    null = F.when(F.col("null_ratio") > 0.5, 2).when(F.col("null_ratio") > 0.2, 1).otherwise(0)
    variance = F.when((F.col("variance") < F.col("_floor")) & (F.col("null_ratio") < 0.9), 2).otherwise(0)
    worst = F.greatest(zero, null, variance)
    return out.withColumn("level", worst.cast("int")).withColumn(
        "severity", F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("healthy")).drop("_floor")


def completeness_band(completeness: Column) -> Column:
    return (
        F.when(completeness >= 0.9, "excellent").when(completeness >= 0.7, "good")
        .when(completeness >= 0.5, "warning").otherwise("critical")
    )


def completeness(obs: DataFrame, days: float, per_day: int = OBSERVATIONS_PER_DAY) -> DataFrame:
    share = F.count(F.lit(1)) / F.lit(float(days * per_day))
    return obs.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("data_points"), share.alias("data_completeness")
    ).withColumn("band", completeness_band(F.col("data_completeness")))


def declining(obs: DataFrame, per_day: int = OBSERVATIONS_PER_DAY, drop: float = 0.1) -> DataFrame:
    """Stations whose daily completeness fell by more than ``drop`` from the first day to the last."""
    daily = obs.groupBy("station_id", F.to_date("time").alias("day")).agg(
        (F.count(F.lit(1)) / F.lit(float(per_day))).alias("share"))
    return daily.groupBy("station_id").agg(
        F.min_by("share", "day").alias("first_share"), F.max_by("share", "day").alias("last_share"),
    ).withColumn("fall", F.col("first_share") - F.col("last_share")).where(F.col("fall") > drop)


def freshness(obs: DataFrame, as_of: Column, fresh_minutes: float = 15, hours: float = 6,
              wanted: int = 36) -> DataFrame:
    """Age of the newest row per station, and whether the last hours hold enough distinct times."""
    age = (seconds(as_of) - seconds("latest")) / 60
    recent = F.when(F.col("time") > as_of - F.make_dt_interval(hours=F.lit(int(hours))), F.col("time"))
    return obs.where(F.col("time") <= as_of).groupBy("station_id").agg(
        F.max("time").alias("latest"), F.count_distinct(recent).alias("recent_times")
    ).withColumn("age_minutes", age).withColumn("is_fresh", F.col("age_minutes") < fresh_minutes).withColumn(
        "is_complete", F.col("recent_times") >= wanted)


def metrics(station: DataFrame, variables: DataFrame) -> DataFrame:
    """Gauges ``metric, labels, value``: completeness, status code and zero ratios."""
    code = F.when(F.col("overall_status") == "healthy", 0.0).when(F.col("overall_status") == "warning", 1.0).otherwise(2.0)
    label = F.create_map(F.lit("station_id"), F.col("station_id").cast("string"))
    have = station.where(F.col("overall_status") != "no_data")
    both = F.map_concat(label, F.create_map(F.lit("variable"), F.col("variable")))
    return (
        have.select(F.lit("station_data_completeness").alias("metric"), label.alias("labels"),
                    F.col("data_completeness").alias("value"))
        .unionByName(have.select(F.lit("station_health_status").alias("metric"), label.alias("labels"),
                                 code.alias("value")))
        .unionByName(variables.select(F.lit("station_zero_ratio").alias("metric"), both.alias("labels"),
                                      F.col("zero_ratio").alias("value")))
    )


def collector_health(log: DataFrame, as_of: Column) -> DataFrame:
    """From the audit log: last success, its age, totals, rate, and the failures since the last success."""
    ok = F.col("status") == "SUCCESS"
    last = log.agg(F.max(F.when(ok, F.col("timestamp"))).alias("last_success"))
    # One row; the log itself is only aggregated.
    since = log.crossJoin(F.broadcast(last)).agg(
        F.max("last_success").alias("last_success"), F.count(F.lit(1)).alias("run_count"),
        F.count_if(~ok).alias("error_count"), F.sum("observations_count").alias("observation_count"),
        F.count_if(~ok & (F.col("last_success").isNull() | (F.col("timestamp") > F.col("last_success")))
                   ).alias("consecutive_failures"),
    )
    return since.withColumn("success_rate", 1 - F.try_divide("error_count", "run_count")).withColumn(
        "age_minutes", (seconds(as_of) - seconds("last_success")) / 60)


def longest_failures(log: DataFrame) -> DataFrame:
    """The longest run of failures that begins on each day; only a success ends a run.

    The successes of the days before are carried into each day, so that a run is known across midnight.
    """
    good = F.when(F.col("status") == "SUCCESS", 1).otherwise(0)
    rows = log.select("id", "timestamp", "status", F.to_date("timestamp").alias("day"))
    rows = carry_parts(rows, [], "day", [F.sum(good).alias("_good")], {
        "_before": lambda w: F.coalesce(F.sum("_good").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    inside = Window.partitionBy("day").orderBy("timestamp", "id")
    runs = rows.withColumn("_run", F.sum(good).over(inside) + F.col("_before")).where(F.col("status") != "SUCCESS").groupBy("_run").agg(
        F.min("day").alias("day"), F.count(F.lit(1)).alias("length"))
    return runs.groupBy("day").agg(F.max("length").alias("longest_failure_run"))
