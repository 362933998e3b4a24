"""Views, scans, profiles, rollups and health over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..config import RAIN, VARIABLES, TimeRange
from ..config import ntz as ntz_lit
from ..functions.columns import round_binary
from ..operators import health, profile, report, views
from ..session import run_folder
from ..sources import adapters as a
from ..sources import tables
from .registry import query, rounded

WINDOW = TimeRange(datetime(2024, 1, 8), datetime(2024, 1, 22, 6))
HOURLY_VARIABLES = tuple(a.EVENT_VARIABLES.values())
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def hourly_long(spark, sf, variables=HOURLY_VARIABLES, span=None):
    """Sevenths, since means of values with two decimals lie on rounding ties."""
    return tables.long_form(a.hourly(spark, sf, span), variables).withColumn("value", F.col("value") / 7)


HOURLY_LONG = a.long_sql("hourly", "whole", HOURLY_VARIABLES) + """,
  long AS (SELECT station_id, time, variable, value / 7 AS value FROM whole)"""
HEAD = a.with_sql(a.HOURLY)
SUPPLIER = a.with_sql(a.SUPPLIER_OBS)


# --- views -----------------------------------------------------------------------------------------------------

@query(HEAD + "SELECT * FROM hourly ORDER BY time DESC, station_id LIMIT 20")
def latest_n(spark, sf):
    return views.latest(a.hourly(spark, sf), 20)


@query(HEAD + """SELECT station_id, time, temp_out, CAST(epoch_us(time) // 1000000 AS BIGINT) AS epoch, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY station_id ORDER BY time DESC) AS INTEGER) AS rank FROM hourly)
  WHERE rank <= 10""")
def latest_per_station(spark, sf):
    return views.latest_per_station(a.hourly(spark, sf), 10).select("station_id", "time", "temp_out", "epoch", "rank")


@query(HEAD + "SELECT * FROM hourly WHERE time = (SELECT max(time) FROM hourly)")
def snapshot_latest(spark, sf):
    return views.snapshot(a.hourly(spark, sf))


@query(SUPPLIER + """SELECT station_id, count(*) AS row_count, min(time) AS first_time, max(time) AS last_time
  FROM supplier_obs GROUP BY 1""")
def station_summary(spark, sf):
    return views.station_summary(a.supplier_obs(spark, sf))


@query(SUPPLIER + """SELECT count(*) AS row_count, count(DISTINCT station_id) AS station_count,
  min(time) AS first_time, max(time) AS last_time FROM supplier_obs""")
def table_summary(spark, sf):
    return views.table_summary(a.supplier_obs(spark, sf))


@query("""SELECT 'stations' AS table_name, count(*) AS row_count FROM supplier
  UNION ALL SELECT 'observations', count(*) FROM lineitem""")
def table_counts(spark, sf):
    return views.table_counts(stations=a.table(spark, sf, "supplier"), observations=a.table(spark, sf, "lineitem"))


@query(a.with_sql(a.STATIONS, a.SUPPLIER_OBS) + """SELECT o.*, s.station_name_en, s.country, s.latitude, s.longitude,
  s.elevation FROM supplier_obs o LEFT JOIN stations s USING (station_id)""")
def obs_with_station(spark, sf):
    return views.with_station(a.supplier_obs(spark, sf), a.stations(spark, sf))


@query(a.with_sql(a.STATIONS) + """SELECT station_id, station_name_en, latitude, longitude, elevation
  FROM stations ORDER BY station_id""")
def station_list(spark, sf):
    return a.stations(spark, sf).select("station_id", "station_name_en", "latitude", "longitude", "elevation").orderBy(
        "station_id")


@query(a.with_sql(a.STATIONS) + """SELECT round(avg(latitude), 6) AS centre_lat, round(avg(longitude), 6) AS centre_lon,
  count(*) AS station_count FROM stations""")
def network_centre(spark, sf):
    return rounded(views.network_centre(a.stations(spark, sf)))


# --- scans and filters -----------------------------------------------------------------------------------------

@query(HEAD + """SELECT station_id, time, temp_out, out_hum, wind_speed, bar, rain FROM hourly
  WHERE time BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-22 06:00:00'""")
def window_scan(spark, sf):
    return tables.scan(a.hourly(spark, sf, WINDOW), WINDOW)


@query(HEAD + """SELECT station_id, time, temp_out, out_hum, wind_speed, bar, rain FROM hourly
  WHERE time >= TIMESTAMP '2024-01-28 12:00:00' AND time < TIMESTAMP '2024-01-30 12:00:00'""")
def window_scan_half_open(spark, sf):
    span = TimeRange.resolve(end="2024-01-30 12:00:00", hours=48, closed="left")
    return tables.scan(a.hourly(spark, sf, span), span)


@query(HEAD + """SELECT station_id, time, bar FROM hourly WHERE station_id IN ('1', '3', '5')""")
def scan_stations_in_list(spark, sf):
    return tables.scan(a.hourly(spark, sf), stations=["1", "3", "5"], variables=["bar", "not_a_column"])


@query(HEAD + """SELECT station_id, time, temp_out FROM hourly WHERE station_id NOT IN ('2', '4')""")
def scan_excluding(spark, sf):
    return tables.scan(a.hourly(spark, sf), exclude=["2", "4"], variables=["temp_out"])


@query(SUPPLIER + """SELECT * FROM supplier_obs
  WHERE time >= (SELECT max(time) FROM supplier_obs) - INTERVAL 1 YEAR""")
def retained_last_year(spark, sf):
    obs = a.supplier_obs(spark, sf)
    newest = a.table(spark, sf, "lineitem").agg(F.date_trunc("week", F.max("l_shipdate"))).first()[0]
    return tables.retained(obs, F.lit(newest).cast("timestamp_ntz"))


@query(HEAD.rstrip() + """, named(variable, label, unit) AS (VALUES ('temp_out', 'Temp', '°C'), ('out_hum', 'Humidity', '%'),
    ('wind_speed', 'Wind', 'km/h'), ('bar', 'Pressure', 'hPa'), ('rain', 'Rain', 'mm')),
  r AS (SELECT * FROM hourly UNPIVOT INCLUDE NULLS (value FOR variable IN (temp_out, out_hum, wind_speed, bar, rain)))
  SELECT variable, label, unit, count(*) AS row_count, count(value) AS n, min(value) AS min, max(value) AS max
  FROM r JOIN named USING (variable) GROUP BY ALL""")
def labelled_variables(spark, sf):
    """What each variable is called and measured in, next to its range."""
    rows = tables.long_form(a.hourly(spark, sf), HOURLY_VARIABLES)
    return tables.labelled(rows.groupBy("variable").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")))


@query(a.with_sql(a.SUPPLIER_OBS, a.long_sql("supplier_obs")) + "SELECT * FROM long")
def long_form(spark, sf):
    return tables.long_form(a.supplier_obs(spark, sf))


@query(a.with_sql(a.STATIONS) + """SELECT s.station_id,
    CASE WHEN c.c_custkey % 5 = 0 THEN 'renamed ' || s.station_id ELSE s.station_name_en END AS station_name_en,
    s.country, s.latitude, s.longitude, CASE WHEN c.c_custkey % 3 = 0 THEN c.c_acctbal ELSE s.elevation END AS elevation
  FROM stations s LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = s.station_id
  WHERE c.c_custkey IS NULL OR c.c_custkey % 7 <> 0""")
def station_overrides(spark, sf):
    k = F.col("c_custkey")
    overrides = a.table(spark, sf, "customer").select(
        k.cast("string").alias("station_id"), (k % 7 != 0).alias("enabled"),
        F.when(k % 5 == 0, F.concat(F.lit("renamed "), k.cast("string"))).alias("station_name_en"),
        F.when(k % 3 == 0, F.col("c_acctbal")).alias("elevation"))
    return tables.station_overrides(a.stations(spark, sf), overrides)


@query(a.with_sql(a.HOURLY, a.HOURLY_STATIONS) + """SELECT h.time, h.station_id, s.station_name_en, h.temp_out, h.rain
  FROM hourly h LEFT JOIN hourly_stations s USING (station_id)""")
def csv_round_trip(spark, sf):
    joined = views.with_station(a.hourly(spark, sf), a.hourly_stations(spark, sf)).select(
        "time", "station_id", "station_name_en", "temp_out", "rain")
    folder = run_folder(spark, "csv")
    tables.export_csv(joined, folder)
    return tables.read_csv(
        spark, folder, "time timestamp_ntz, station_id string, station_name_en string, temp_out double, rain double")


@query(a.with_sql(a.STATIONS, a.SUPPLIER_OBS) + """SELECT row_number() OVER (ORDER BY o.time DESC, o.station_id) AS position, o.time, o.station_id,
  s.station_name_en, s.elevation FROM supplier_obs o LEFT JOIN stations s USING (station_id)""")
def ordered_export(spark, sf):
    """The joined export, newest first: its files follow each other in that order."""
    joined = views.with_station(a.supplier_obs(spark, sf), a.stations(spark, sf))
    folder = run_folder(spark, "export")
    tables.export_csv(views.newest_first(joined).select("position", "time", "station_id", "station_name_en", "elevation"), folder)
    return tables.read_csv(
        spark, folder, "position long, time timestamp_ntz, station_id string, station_name_en string, elevation double")


@query(a.with_sql(a.HOURLY, HOURLY_LONG) + """SELECT station_id, variable, count(*) AS data_points,
  round(count(CASE WHEN value = 0 THEN 1 END) / count(*), 6) AS zero_ratio FROM long GROUP BY 1, 2""")
def json_round_trip(spark, sf):
    stats = rounded(health.ratios(hourly_long(spark, sf))).select("station_id", "variable", "data_points", "zero_ratio")
    folder = run_folder(spark, "json")
    tables.export_json(stats, folder)
    return spark.read.json(folder, schema=stats.schema)


@query(HEAD + """SELECT * FROM hourly WHERE time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-12 12:00:00'""")
def partitioned_table(spark, sf):
    """Write by day, read a range back: only its days are opened."""
    folder = run_folder(spark, "observations")
    tables.write_observations(a.hourly(spark, sf), folder)
    span = TimeRange(datetime(2024, 1, 10), datetime(2024, 1, 12, 12))
    return tables.read_observations(spark, folder, span).drop("obs_date")


@query(SUPPLIER + """SELECT station_id, min(time) AS window_start, max(time) AS window_end, count(*) AS data_count
  FROM supplier_obs GROUP BY 1""")
def window_metadata(spark, sf):
    return report.window_metadata(a.supplier_obs(spark, sf))


# --- profiles and rollups --------------------------------------------------------------------------------------

def _profile_sql(keys: str, source: str) -> str:
    """All ten fields; edges and counts as one row per group."""
    k = ", ".join(f"b.{c.strip()}" for c in keys.split(","))
    on = " AND ".join(f"b.{c.strip()} = m.{c.strip()}" for c in keys.split(","))
    return f""", m AS (SELECT {keys}, count(*) AS row_count, count(value) AS n, avg(value) AS mean, median(value) AS median,
    stddev_samp(value) AS std, min(value) AS lo0, max(value) AS hi0, count(DISTINCT value) AS unique_count
    FROM {source} GROUP BY {keys}),
  lim AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5::DOUBLE ELSE lo0 END AS lo,
    CASE WHEN lo0 = hi0 THEN hi0 + 0.5::DOUBLE ELSE hi0 END AS hi FROM m),
  binned AS (SELECT {k}, least(floor((b.value - m.lo) / (m.hi - m.lo) * 10), 9) AS bin, count(*) AS c
    FROM {source} b JOIN lim m ON {on} WHERE b.value IS NOT NULL GROUP BY ALL),
  dense AS (SELECT {", ".join("m." + c.strip() for c in keys.split(","))}, i.i AS bin, coalesce(b.c, 0) AS c
    FROM lim m CROSS JOIN (SELECT unnest(range(0, 10)) AS i) i LEFT JOIN binned b ON {on} AND b.bin = i.i WHERE m.n > 0),
  hist AS (SELECT {keys}, list(c ORDER BY bin) AS hist_counts FROM dense GROUP BY {keys})
"""


def _fixed(x: str, digits: int = 4) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _profile_select(keys: str) -> str:
    return f"""SELECT {keys}, row_count, {_fixed('mean')} AS mean, {_fixed('median')} AS median,
    {_fixed('CASE WHEN n > 1 THEN std END')} AS std, {_fixed('lo0')} AS min, {_fixed('hi0')} AS max,
    row_count - n AS missing_count, {_fixed('(row_count - n) / row_count * 100', 2)} AS missing_percentage, unique_count,
    array_to_string(hist_counts, ',') AS hist_counts, {_fixed(_fixed('hi') + ' - ' + _fixed('lo'))} AS hist_range
  FROM lim LEFT JOIN hist USING ({keys})"""


def _flat(df):
    """Histogram as text and the width of its range, so that both engines print the same."""
    n = F.size("hist_bins")
    return df.withColumn("hist_counts", F.when(n > 0, F.concat_ws(",", F.col("hist_counts").cast("array<string>")))
                         ).withColumn("hist_range", F.when(n > 0, round_binary(
                             F.get("hist_bins", F.lit(10)) - F.get("hist_bins", F.lit(0)), 4))).drop("hist_bins")


@query(a.with_sql(a.HOURLY, HOURLY_LONG).rstrip() + _profile_sql("station_id, variable", "long")
       + _profile_select("station_id, variable"))
def profile_station(spark, sf):
    return _flat(profile.column_profile(hourly_long(spark, sf)))


@query(a.with_sql(a.HOURLY, HOURLY_LONG).rstrip() + _profile_sql("variable", "long") + _profile_select("variable"))
def profile_global(spark, sf):
    return _flat(profile.column_profile(hourly_long(spark, sf), ["variable"]))


_PROFILE_WINDOW = """, w AS (SELECT * FROM long
  WHERE time >= TIMESTAMP '2024-01-29' AND time < TIMESTAMP '2024-01-31')"""


@query(a.with_sql(a.HOURLY, HOURLY_LONG).rstrip() + _PROFILE_WINDOW + _profile_sql("station_id, variable", "w")
       + _profile_select("station_id, variable"))
def profile_window(spark, sf):
    span = TimeRange.resolve(end=a.AS_OF, hours=48, closed="left")
    return _flat(profile.column_profile(hourly_long(spark, sf, span=span).where(span.contains())))


@query(a.with_sql(a.HOURLY, HOURLY_LONG).rstrip() + _profile_sql("station_id, variable", "long") + """
  SELECT station_id, variable, CAST(d.bin AS INTEGER) AS bin, d.c AS bin_count,
    CAST(printf('%.4f', l.lo + (l.hi - l.lo) * d.bin / 10) AS DOUBLE) AS low_edge
  FROM dense d JOIN lim l USING (station_id, variable)""")
def profile_histogram(spark, sf):
    p = profile.column_profile(hourly_long(spark, sf))
    rows = p.select("station_id", "variable", "hist_bins", F.posexplode("hist_counts").alias("bin", "bin_count"))
    return rows.select("station_id", "variable", "bin", "bin_count", F.get("hist_bins", F.col("bin")).alias("low_edge"))


@query()
def profile_quick(spark, sf):
    return rounded(profile.quick_profile(a.events_long(spark, sf)), 4)


@query(a.with_sql(a.HOURLY, HOURLY_LONG) + """SELECT variable, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std FROM long GROUP BY 1""")
def plotted_statistics(spark, sf):
    p = hourly_long(spark, sf).groupBy("variable").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return rounded(p)


ROLLUP = """SELECT date_trunc('hour', time) AS bucket, station_id, count(*) AS row_count,
  round(avg(temp_out), 2) AS mean_temp, round(stddev_samp(temp_out), 2) AS std_temp, min(temp_out) AS min_temp,
  max(temp_out) AS max_temp, count(*) FILTER (WHERE temp_out IS NULL) AS missing_temp, round(avg(out_hum), 2) AS mean_hum,
  round(avg(wind_speed), 2) AS mean_wind, round(avg(bar), 2) AS mean_bar FROM wide GROUP BY 1, 2"""
# One row per event, so that an hour holds several: values are shifted off the rounding ties of two decimals.
WIDE_EVENTS = """wide AS (SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS time,
  CASE WHEN event_type = 'click' THEN value / 7 END AS temp_out, CASE WHEN event_type = 'view' THEN value / 7 END AS out_hum,
  CASE WHEN event_type = 'purchase' THEN value / 7 END AS wind_speed, CASE WHEN event_type = 'signup' THEN value / 7 END AS bar
  FROM events)"""


def wide_events(spark, sf):
    e = a.table(spark, sf, "events")
    names = {k: v for k, v in a.EVENT_VARIABLES.items() if v != "rain"}
    return e.select(F.col("user_id").cast("string").alias("station_id"), a.ntz(F.col("ts")).alias("time"),
                    *[F.when(F.col("event_type") == k, F.col("value") / 7).alias(v) for k, v in names.items()])


@query(a.with_sql(WIDE_EVENTS) + ROLLUP)
def hourly_rollup(spark, sf):
    return profile.rollup(wide_events(spark, sf))


@query(a.with_sql(WIDE_EVENTS) + ROLLUP + " ORDER BY bucket DESC, station_id LIMIT 50")
def hourly_rollup_latest(spark, sf):
    return profile.rollup(wide_events(spark, sf)).orderBy(F.desc("bucket"), "station_id").limit(50)


_MAPPING = """mapping AS (SELECT CAST(s_suppkey % 14 AS VARCHAR) || '/' || v AS node_key, min('node-' || s_suppkey || '-' || v) AS node_id
  FROM supplier, (SELECT unnest(['temp_out', 'bar', 'rain']) AS v) WHERE s_suppkey % 14 <> 9 GROUP BY 1)"""


def _mapping(spark, sf):
    k = F.col("s_suppkey")
    rows = a.table(spark, sf, "supplier").where(k % 14 != 9).select(
        k, F.explode(F.array(*[F.lit(v) for v in ("temp_out", "bar", "rain")])).alias("v"))
    return rows.groupBy(F.concat_ws("/", (k % 14).cast("string"), "v").alias("node_key")).agg(
        F.min(F.concat_ws("-", F.lit("node"), k, "v")).alias("node_id"))


@query(a.with_sql(a.HOURLY, HOURLY_LONG, _MAPPING) + """SELECT node_id, station_id, variable, row_count, mean FROM (
    SELECT station_id, variable, count(*) AS row_count, CAST(printf('%.4f', avg(value)) AS DOUBLE) AS mean FROM long GROUP BY 1, 2)
  JOIN mapping ON node_key = station_id || '/' || variable""")
def payload_join(spark, sf):
    mapped, _ = profile.payload(profile.column_profile(hourly_long(spark, sf)), _mapping(spark, sf))
    return mapped.select(
        "node_id", "station_id", "variable",
        F.get_json_object("statistics", "$.row_count").cast("long").alias("row_count"),
        F.get_json_object("statistics", "$.mean").cast("double").alias("mean"))


@query(a.with_sql(a.HOURLY, HOURLY_LONG, _MAPPING) + """SELECT DISTINCT station_id, variable,
  station_id || '/' || variable AS node_key FROM long WHERE station_id || '/' || variable NOT IN (SELECT node_key FROM mapping)""")
def payload_unmapped(spark, sf):
    _, unmapped = profile.payload(profile.column_profile(hourly_long(spark, sf)), _mapping(spark, sf))
    return unmapped


# --- health ----------------------------------------------------------------------------------------------------

def stalled_long(spark, sf):
    """Readings with planted gaps and zeros: every 17th event is missing, users divisible by 4 read zero often."""
    e = a.table(spark, sf, "events")
    value = F.when(F.col("event_id") % 17 == 0, None).when(
        (F.col("user_id") % 4 == 0) & (F.col("event_id") % 3 == 0), 0.0).when(
        F.col("user_id") % 9 == 0, 5.0).otherwise(F.col("value"))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in a.EVENT_VARIABLES.items() for x in kv]), F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("station_id"), a.ntz(F.col("ts")).alias("time"),
                    named.alias("variable"), value.alias("value"))


STALLED = """stalled AS (SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS time,
  CASE event_type WHEN 'click' THEN 'temp_out' WHEN 'view' THEN 'out_hum' WHEN 'purchase' THEN 'wind_speed'
    WHEN 'signup' THEN 'bar' ELSE 'rain' END AS variable,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 4 = 0 AND event_id % 3 = 0 THEN 0.0::DOUBLE
    WHEN user_id % 9 = 0 THEN 5.0::DOUBLE ELSE value END AS value FROM events)"""
def _eight(df):
    """Variances of few values with two decimals tie at six digits, not at eight."""
    ratios = df.withColumn("zero_ratio", F.round("zero_ratio", 6)).withColumn("null_ratio", F.round("null_ratio", 6))
    return ratios.withColumn("variance", F.round("variance", 8))


RATIOS = """ratios AS (SELECT station_id, variable, count(*) AS data_points,
  count(CASE WHEN value = 0 THEN 1 END) / count(*) AS zero_ratio, (count(*) - count(value)) / count(*) AS null_ratio,
  CASE WHEN count(value) > 1 THEN var_samp(value) ELSE 0 END AS variance FROM stalled GROUP BY 1, 2)"""
ISSUES = """judged AS (SELECT *, zero_ratio > 0.3 AS i1, null_ratio > 0.5 AS i2, variance < 0.1 AND null_ratio < 0.9 AS i3
  FROM ratios)"""
_ISSUE_TEXT = """concat_ws('; ',
  CASE WHEN i1 THEN printf('High zero ratio (%.1f%%) - sensor may be stalled', zero_ratio * 100) END,
  CASE WHEN i2 THEN printf('High missing rate (%.1f%%)', null_ratio * 100) END,
  CASE WHEN i3 THEN printf('Low variance (%.3f) - sensor may be stuck', variance) END)"""


@query(a.with_sql(STALLED, RATIOS, ISSUES) + f"""SELECT station_id, variable, data_points, round(zero_ratio, 6) AS zero_ratio,
  round(null_ratio, 6) AS null_ratio, round(variance, 8) AS variance, {_ISSUE_TEXT} AS issues,
  CASE WHEN i1 OR i2 OR i3 THEN 'critical' ELSE 'healthy' END AS severity FROM judged""")
def health_variables(spark, sf):
    h = health.variable_health(stalled_long(spark, sf))
    return _eight(h.withColumn("issues", F.concat_ws("; ", "issues")))


@query(a.with_sql(STALLED, RATIOS, ISSUES) + """SELECT CAST(u.k AS VARCHAR) AS station_id, 30 AS days,
  CAST(coalesce(sum(data_points), 0) AS BIGINT) AS data_points, round(sum(data_points) / (30 * 144.0::DOUBLE), 6) AS data_completeness,
  CASE WHEN sum(data_points) IS NULL THEN 'no_data' WHEN bool_or((i1 OR i2 OR i3) AND j.variable = 'wind_speed') THEN 'critical' ELSE 'healthy' END AS overall_status,
  CAST(coalesce(sum(CASE WHEN j.variable = 'wind_speed' THEN CAST(i1 AS INTEGER) + CAST(i2 AS INTEGER) + CAST(i3 AS INTEGER) END), 0) AS BIGINT) AS issue_count
  FROM (SELECT s_suppkey AS k FROM supplier) u LEFT JOIN judged j ON j.station_id = CAST(u.k AS VARCHAR)
  GROUP BY u.k""")
def health_station(spark, sf):
    rows = stalled_long(spark, sf)
    wind = rows.where(F.col("variable") == "wind_speed")
    return rounded(health.station_health(wind, a.stations(spark, sf), 30, rows=rows))


@query(a.with_sql(STALLED, RATIOS) + """SELECT station_id, variable, data_points, round(zero_ratio, 6) AS zero_ratio,
  round(null_ratio, 6) AS null_ratio, round(variance, 8) AS variance, level,
  CASE level WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS severity FROM (
    SELECT *, greatest(CASE WHEN zero_ratio > 0.5 THEN 2 WHEN zero_ratio > 0.3 THEN 1 ELSE 0 END,
      CASE WHEN null_ratio > 0.5 THEN 2 WHEN null_ratio > 0.2 THEN 1 ELSE 0 END,
      CASE WHEN null_ratio < 0.9 AND variance < CASE variable WHEN 'temp_out' THEN 0.5 WHEN 'out_hum' THEN 5 ELSE 0.1 END
        THEN 2 ELSE 0 END) AS level FROM ratios)""")
def health_graded(spark, sf):
    return _eight(health.graded_health(stalled_long(spark, sf), (*VARIABLES, RAIN)))


@query(a.with_sql(STALLED, RATIOS, ISSUES, """station AS (SELECT station_id, max(data_points) / (30 * 144.0::DOUBLE) AS c,
  bool_or(i1 OR i2 OR i3) AS critical FROM judged GROUP BY 1)""") + """
  SELECT 'station_data_completeness' AS metric, station_id AS station, NULL AS variable, round(c, 6) AS value FROM station
  UNION ALL SELECT 'station_health_status', station_id, NULL, CASE WHEN critical THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END FROM station
  UNION ALL SELECT 'station_zero_ratio', station_id, variable, round(zero_ratio, 6) FROM ratios""")
def metrics_long(spark, sf):
    long = stalled_long(spark, sf)
    known = long.select("station_id").distinct()
    m = health.metrics(health.station_health(long, known, 30), health.ratios(long))
    return rounded(m.select("metric", F.try_element_at("labels", F.lit("station_id")).alias("station"),
                            F.try_element_at("labels", F.lit("variable")).alias("variable"), "value"))


@query(HEAD + """SELECT station_id, data_points, round(c, 6) AS data_completeness, CASE WHEN c >= 0.9 THEN 'excellent'
  WHEN c >= 0.7 THEN 'good' WHEN c >= 0.5 THEN 'warning' ELSE 'critical' END AS band
  FROM (SELECT station_id, count(*) AS data_points, count(*) / (30 * 24.0::DOUBLE) AS c FROM hourly GROUP BY 1)""")
def completeness(spark, sf):
    return rounded(health.completeness(a.hourly(spark, sf), 30, per_day=24))


@query(a.with_sql(a.EVENTS_LONG) + f"""SELECT station_id, latest, recent_times,
  round((epoch_us({AS_OF_SQL}) - epoch_us(latest)) / 60000000, 4) AS age_minutes,
  (epoch_us({AS_OF_SQL}) - epoch_us(latest)) / 60000000 < 15 AS is_fresh, recent_times >= 36 AS is_complete
  FROM (SELECT station_id, max(time) AS latest,
    count(DISTINCT CASE WHEN time > {AS_OF_SQL} - INTERVAL 6 HOUR THEN time END) AS recent_times FROM events_long GROUP BY 1)""")
def freshness(spark, sf):
    return rounded(health.freshness(a.events_long(spark, sf), ntz_lit(a.AS_OF)), 4)


@query(HEAD + """SELECT station_id, round(first_share, 6) AS first_share, round(last_share, 6) AS last_share,
  round(first_share - last_share, 6) AS fall FROM (
    SELECT station_id, arg_min(share, day) AS first_share, arg_max(share, day) AS last_share FROM (
      SELECT station_id, CAST(time AS DATE) AS day, count(*) / 24.0::DOUBLE AS share FROM hourly GROUP BY 1, 2) GROUP BY 1)
  WHERE first_share - last_share > 0.1""")
def health_decline(spark, sf):
    return rounded(health.declining(a.hourly(spark, sf), per_day=24))


def collection_log(spark, sf):
    """Orders as collection runs: open ones are failures."""
    o = a.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
         ).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "O", "ERROR").otherwise("SUCCESS").alias("status"),
        F.lit(14).alias("stations_count"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.col("o_custkey") % 15).cast("int").alias("observations_count"),
        F.lit("").alias("message"))


LOG = """log AS (SELECT o_orderkey AS id, o_orderdate + to_seconds(o_orderkey % 86400) AS timestamp,
  CASE WHEN o_orderstatus = 'O' THEN 'ERROR' ELSE 'SUCCESS' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey % 15 END AS observations_count FROM orders)"""


@query(a.with_sql(LOG) + """SELECT last_success, run_count, error_count, CAST(observation_count AS BIGINT) AS observation_count,
  consecutive_failures, round(1 - error_count / run_count, 6) AS success_rate,
  round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(last_success)) / 60000000, 4) AS age_minutes FROM (
  SELECT max(CASE WHEN status = 'SUCCESS' THEN timestamp END) AS last_success, count(*) AS run_count,
    count(CASE WHEN status <> 'SUCCESS' THEN 1 END) AS error_count, sum(observations_count) AS observation_count,
    count(CASE WHEN status <> 'SUCCESS' AND timestamp > (SELECT max(timestamp) FROM log WHERE status = 'SUCCESS') THEN 1 END)
      AS consecutive_failures FROM log)""")
def collector_health(spark, sf):
    return rounded(health.collector_health(collection_log(spark, sf), ntz_lit(datetime(2002, 1, 1))), 6).withColumn(
        "age_minutes", F.round("age_minutes", 4))


@query(a.with_sql(LOG) + """SELECT day, max(n) AS longest_failure_run FROM (
  SELECT min(day) AS day, run, count(*) AS n FROM (SELECT CAST(timestamp AS DATE) AS day, status, sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END)
    OVER (ORDER BY timestamp, id) AS run FROM log)
  WHERE status <> 'SUCCESS' GROUP BY run) GROUP BY 1""")
def failure_runs(spark, sf):
    return health.longest_failures(collection_log(spark, sf))
