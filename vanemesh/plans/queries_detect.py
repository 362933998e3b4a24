"""Point detectors, their summaries and station status over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DETECTED, VariableConfig
from ..operators import model, point, report
from ..sources import adapters as a
from ..sources import tables
from .registry import query, rounded

RECORD = ("station_id", "variable", "time", "value", "expected", "deviation", "score", "lower", "upper")
SQL_HEAD = a.with_sql(a.SUPPLIER_OBS, a.long_sql("supplier_obs"))
_KEYS = "station_id, variable"


def long(spark, sf):
    return tables.long_form(a.supplier_obs(spark, sf))


def gappy(spark, sf):
    """The hourly table, whose variables are NULL in hours without an event."""
    return tables.long_form(a.hourly(spark, sf), DETECTED)


GAPPY = a.with_sql(a.HOURLY, a.long_sql("hourly"))


def shown(df):
    """Eight digits: limits of values with five decimals tie at six."""
    return rounded(df.select(*RECORD), 8)


def _select(expected, score, lower, upper, source, where):
    return f"""SELECT station_id, variable, time, round(value, 8) AS value, round({expected}, 8) AS expected,
  round(value - ({expected}), 8) AS deviation, round({score}, 8) AS score, round({lower}, 8) AS lower, round({upper}, 8) AS upper
  FROM {source} WHERE {where}"""


def _three_sigma(source="long", usable="n >= 3", k="3"):
    stats = f"""(SELECT {_KEYS}, count(*) AS total, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd
    FROM {source} GROUP BY ALL)"""
    return _select("mean", "abs(value - mean) / sd", f"mean - {k} * sd", f"mean + {k} * sd",
                   f"{source} JOIN {stats} s USING ({_KEYS})",
                   f"{usable} AND sd > 1e-12 AND (value > mean + {k} * sd OR value < mean - {k} * sd)")


def _mad(scale, k, source="long"):
    med = f"""(SELECT {_KEYS}, median(value) AS med, count(value) AS n FROM {source} GROUP BY ALL)"""
    mad = f"""(SELECT {_KEYS}, any_value(med) AS med, any_value(n) AS n, median(abs(value - med)) AS mad
    FROM {source} JOIN {med} m USING ({_KEYS}) GROUP BY ALL)"""
    score = f"{scale} * abs(value - med) / mad"
    return _select("med", score, f"med - mad * {k} / {scale}", f"med + mad * {k} / {scale}",
                   f"{source} JOIN {mad} s USING ({_KEYS})", f"n >= 3 AND mad > 0 AND {score} > {k}")


def _iqr(source="long"):
    q = f"""(SELECT {_KEYS}, count(value) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS med,
    quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY ALL)"""
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    return _select("med", "CASE WHEN q3 > q1 THEN abs(value - med) / (q3 - q1) END", low, high,
                   f"{source} JOIN {q} s USING ({_KEYS})", f"n >= 3 AND (value < {low} OR value > {high})")


def _count(sql, method):
    return f"SELECT '{method}' AS method, station_id, variable FROM ({sql})"


@query(SQL_HEAD + _three_sigma())
def point_3sigma(spark, sf):
    return shown(point.three_sigma(long(spark, sf)))


@query(GAPPY + _three_sigma())
def point_3sigma_gappy(spark, sf):
    """Missing readings are skipped."""
    return shown(point.three_sigma(gappy(spark, sf)))


@query(a.with_sql(a.EVENTS_LONG, """holed AS (SELECT station_id, variable, time,
  CASE WHEN variable = 'click' AND epoch_us(time) % 501 = 0 THEN NULL ELSE value END AS value FROM events_long)""")
       + _three_sigma("holed", "total >= 3 AND n = total"))
def point_3sigma_propagate(spark, sf):
    """One missing reading silences its series."""
    e = a.events_long(spark, sf)
    hole = (F.col("variable") == "click") & (F.unix_micros(F.col("time").cast("timestamp")) % 501 == 0)
    return shown(point.three_sigma(e.withColumn("value", F.when(~hole, F.col("value"))), on_null="propagate"))


@query(SQL_HEAD + _mad(0.6745, 3))
def point_zscore(spark, sf):
    return shown(point.modified_zscore(long(spark, sf)))


@query(GAPPY + _mad(1.0, 3.5))
def point_mad_raw(spark, sf):
    return shown(point.raw_mad(gappy(spark, sf)))


@query(SQL_HEAD + _iqr())
def point_iqr(spark, sf):
    return shown(point.iqr(long(spark, sf)))


@query(GAPPY + _select(
    "prev", "abs(value - prev)", "prev - lim", "prev + lim",
    """(SELECT *, lag(value) OVER (PARTITION BY station_id, variable ORDER BY time) AS prev,
      CASE variable WHEN 'temp_out' THEN 5 WHEN 'bar' THEN 10 END AS lim FROM long WHERE value IS NOT NULL)""",
    "abs(value - prev) > lim"))
def point_sudden_change(spark, sf):
    return shown(point.sudden_change(gappy(spark, sf)))


@query(GAPPY + """SELECT station_id, variable, time, round(value, 6) AS value, lo AS lower, hi AS upper,
    round(greatest(lo - value, value - hi, 0), 6) AS score
  FROM long JOIN (VALUES ('temp_out', -10::DOUBLE, 40::DOUBLE), ('out_hum', 0, 100), ('wind_speed', 0, 100), ('bar', 950, 1050))
    c(variable, lo, hi) USING (variable)
  WHERE value < lo OR value > hi OR value IN (99.0, 999.9, -127, -999)""")
def point_range(spark, sf):
    r = point.physical_range(gappy(spark, sf))
    return rounded(r.select("station_id", "variable", "time", "value", "lower", "upper", "score"))


_SEASONAL = """, s0 AS (SELECT *, row_number() OVER w - 1 AS idx,
    CASE WHEN count(value) OVER c = 13 THEN avg(value) OVER c END AS trend FROM long WHERE value IS NOT NULL
    WINDOW w AS (PARTITION BY station_id, variable ORDER BY time),
      c AS (PARTITION BY station_id, variable ORDER BY time ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
  s1 AS (SELECT *, idx % 13 AS phase, value - trend AS rest FROM s0 WHERE trend IS NOT NULL),
  s2 AS (SELECT *, avg(rest) OVER (PARTITION BY station_id, variable, phase) AS season FROM s1),
  s3 AS (SELECT *, rest - season AS resid, stddev_pop(rest - season) OVER p AS sd, count(*) OVER p AS total FROM s2
    WINDOW p AS (PARTITION BY station_id, variable))
"""


@query(SQL_HEAD.rstrip() + _SEASONAL + _select(
    "trend + season", "abs(resid) / sd", "trend + season - 3 * sd", "trend + season + 3 * sd", "s3",
    "total >= 26 AND abs(resid) > 3 * sd"))
def seasonal_residual(spark, sf):
    return shown(point.seasonal_residual(long(spark, sf)))


_LOF = """, v AS (SELECT station_id, variable, value, count(*) AS copies FROM long WHERE value IS NOT NULL GROUP BY ALL),
  big AS (SELECT station_id, variable FROM v GROUP BY ALL HAVING sum(copies) > 20),
  c AS (SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY value, copy) AS i FROM (
    SELECT v.*, unnest(range(1, CAST(least(copies, 21) + 1 AS BIGINT))) AS copy FROM v JOIN big USING (station_id, variable))),
  near AS (SELECT * FROM (SELECT a.station_id, a.variable, a.i, b.i AS j, abs(b.value - a.value) AS d,
      row_number() OVER (PARTITION BY a.station_id, a.variable, a.i ORDER BY abs(b.value - a.value), b.value, b.i) AS r
    FROM c a JOIN c b ON a.station_id = b.station_id AND a.variable = b.variable AND b.i BETWEEN a.i - 20 AND a.i + 20 AND a.i <> b.i)
    WHERE r <= 20),
  reach AS (SELECT station_id, variable, i, max(d) AS kd FROM near GROUP BY ALL),
  dens AS (SELECT n.station_id, n.variable, n.i, 1.0::DOUBLE / (avg(greatest(n.d, q.kd)) + 1e-10) AS lrd
    FROM near n JOIN reach q ON n.station_id = q.station_id AND n.variable = q.variable AND n.j = q.i GROUP BY ALL),
  fac AS (SELECT n.station_id, n.variable, n.i, avg(o.lrd) / any_value(m.lrd) AS factor
    FROM near n JOIN dens o ON n.station_id = o.station_id AND n.variable = o.variable AND n.j = o.i
      JOIN dens m ON n.station_id = m.station_id AND n.variable = m.variable AND n.i = m.i GROUP BY ALL),
  sc AS (SELECT c.station_id, c.variable, c.value, f.factor FROM c JOIN fac f USING (station_id, variable, i) WHERE copy = 1),
  rowsc AS (SELECT l.station_id, l.variable, l.time, l.value, -factor AS score FROM long l JOIN sc USING (station_id, variable, value)),
  lim AS (SELECT station_id, variable, quantile_cont(score, 0.1) AS cut FROM rowsc GROUP BY ALL)
"""


@query(SQL_HEAD.rstrip() + _LOF + """SELECT station_id, variable, time, round(value, 6) AS value, round(ln(-score), 6) AS log_score
  FROM rowsc JOIN lim USING (station_id, variable) WHERE score < cut""")
def lof(spark, sf):
    found = point.lof(long(spark, sf))
    return rounded(found.select("station_id", "variable", "time", "value", F.ln("score").alias("log_score")))


CONFIGURED = (
    VariableConfig("temp_out", "Temp", "°C", 2.5, "3sigma"), VariableConfig("out_hum", "Humidity", "%", 3.0, "zscore"),
    VariableConfig("wind_speed", "Wind", "km/h", 3.0, "iqr"), VariableConfig("bar", "Pressure", "hPa", 4.0, "mad"),
)


@query(SQL_HEAD + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT * FROM ({sql}) WHERE variable = '{v}'" for v, sql in (
        ("temp_out", _three_sigma(k="2.5")), ("out_hum", _mad(0.6745, 3)), ("wind_speed", _iqr()), ("bar", _mad(1.0, 4.0)))
) + ")")
def point_configured(spark, sf):
    return shown(point.detect_configured(long(spark, sf), CONFIGURED))


@query(SQL_HEAD + """SELECT method, count(*) AS flag_count, count(DISTINCT station_id) AS station_count,
  count(DISTINCT station_id || '/' || variable) AS series_count FROM ("""
       + " UNION ALL ".join(_count(s, m) for m, s in (
           ("3sigma", _three_sigma()), ("zscore", _mad(0.6745, 3)), ("mad", _mad(1.0, 3.5)), ("iqr", _iqr())))
       + ") GROUP BY 1")
def method_comparison(spark, sf):
    return point.compare_methods(long(spark, sf), ["3sigma", "zscore", "mad", "iqr"])


FLAGGED = f", flagged AS ({_mad(0.6745, 3)})"


@query(GAPPY.rstrip() + FLAGGED + """
  SELECT station_id, variable, time, value, CAST(rank AS INTEGER) AS rank, total, greatest(total - 3, 0) AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY time) AS rank,
      count(*) OVER (PARTITION BY station_id, variable) AS total FROM flagged) WHERE rank <= 3""")
def top3_records(spark, sf):
    first = point.first_records(point.modified_zscore(gappy(spark, sf)), 3)
    return rounded(first.select("station_id", "variable", "time", "value", "rank", "total", "more"))


EVENT_FLAGS = a.with_sql(a.EVENTS_LONG, """series AS (SELECT CAST(CAST(station_id AS BIGINT) % 14 AS VARCHAR) AS station_id,
  variable, time, value FROM events_long)""").rstrip() + f", flagged AS ({_three_sigma('series')})"
_STATUS = """SELECT k AS station_id, total_points, point_variables, total_events,
  CASE WHEN total_points = 0 AND total_events = 0 THEN 'normal' WHEN total_points > 5 OR total_events > 3 THEN 'critical'
    WHEN total_points > 2 OR total_events > 1 THEN 'warning' ELSE 'attention' END AS overall_status
  FROM (SELECT s.k, count(f.time) AS total_points, 0::BIGINT AS total_events,
    coalesce(string_agg(DISTINCT f.variable, ',' ORDER BY f.variable), '') AS point_variables
    FROM (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS k FROM supplier) s LEFT JOIN flagged f ON f.station_id = s.k GROUP BY 1)"""


def event_series(spark, sf):
    e = a.events_long(spark, sf)
    return e.withColumn("station_id", (F.col("station_id").cast("long") % 14).cast("string"))


def event_status(spark, sf):
    found = point.three_sigma(event_series(spark, sf))
    return report.station_status(a.stations(spark, sf), found)


@query(EVENT_FLAGS + _STATUS)
def overall_status(spark, sf):
    s = event_status(spark, sf).drop("event_variables")
    return s.withColumn("point_variables", F.array_join("point_variables", ","))


@query(EVENT_FLAGS + f""", st AS ({_STATUS}) SELECT station_id, total_points, CASE WHEN total_points > 10 THEN 'critical'
  WHEN total_points > 5 THEN 'warning' WHEN total_points > 0 THEN 'attention' ELSE 'normal' END AS documented_status FROM st""")
def documented_status(spark, sf):
    return report.documented_status(event_status(spark, sf)).select("station_id", "total_points", "documented_status")


@query(EVENT_FLAGS + f""", st AS ({_STATUS}) SELECT count(*) AS station_count,
  count(CASE WHEN total_points > 0 THEN 1 END) AS with_points, count(CASE WHEN total_events > 0 THEN 1 END) AS with_events,
  CAST(sum(total_points) AS BIGINT) AS point_total, CAST(sum(total_events) AS BIGINT) AS event_total FROM st""")
def run_summary(spark, sf):
    return report.run_summary(event_status(spark, sf))


@query(EVENT_FLAGS + """SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS station_id FROM supplier
  WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT station_id FROM flagged)""")
def normal_stations(spark, sf):
    found = point.three_sigma(event_series(spark, sf))
    return report.normal_stations(a.stations(spark, sf).select("station_id"), found)


@query(a.with_sql(a.EVENTS_LONG, """w AS (
    SELECT time_bucket(INTERVAL 6 HOURS, time, TIMESTAMP '1970-01-01') AS window_start, CAST(CAST(station_id AS BIGINT) % 2 AS VARCHAR) AS station_id,
    variable, time, value FROM events_long)""", """st AS (SELECT window_start, station_id, variable, count(value) AS n, avg(value) AS mean,
    stddev_pop(value) AS sd FROM w GROUP BY ALL)""") + """SELECT window_start, station_id, variable, count(*) AS flag_count,
    count(CASE WHEN value > mean THEN 1 END) AS high_count, count(CASE WHEN value < mean THEN 1 END) AS low_count
  FROM w JOIN st USING (window_start, station_id, variable) WHERE n >= 3 AND sd > 1e-12 AND abs(value - mean) > 2 * sd GROUP BY 1, 2, 3""")
def sweep_6h(spark, sf):
    """The detector over every 6-hour window at once: the window is one more key."""
    halves = a.events_long(spark, sf).withColumn("station_id", (F.col("station_id").cast("long") % 2).cast("string"))
    found = point.three_sigma(report.sweep(halves).withColumn("variable", F.struct("window_start", "variable")), 2.0)
    return found.groupBy(F.col("variable.window_start").alias("window_start"), "station_id", F.col("variable.variable").alias("variable")).agg(
        F.count(F.lit(1)).alias("flag_count"), F.count_if(F.col("value") > F.col("expected")).alias("high_count"),
        F.count_if(F.col("value") < F.col("expected")).alias("low_count"))


@query(a.with_sql(a.EVENTS_LONG, """w AS (
    SELECT time_bucket(INTERVAL 6 HOURS, time, TIMESTAMP '1970-01-01') AS window_start, CAST(CAST(station_id AS BIGINT) % 14 AS VARCHAR) AS station_id,
    variable, time, value FROM events_long)""", """st AS (SELECT window_start, station_id, variable, count(value) AS n, avg(value) AS mean,
    stddev_pop(value) AS sd FROM w GROUP BY ALL)""") + """SELECT window_start, station_id, variable, count(*) AS flag_count,
    count(CASE WHEN value > mean THEN 1 END) AS high_count, count(CASE WHEN value < mean THEN 1 END) AS low_count
  FROM w JOIN st USING (window_start, station_id, variable) WHERE n >= 3 AND sd > 1e-12 AND abs(value - mean) > 3 * sd GROUP BY 1, 2, 3""")
def sweep_6h_station(spark, sf):
    """The sweep for each station, with the detector's own limit; ``sweep_6h`` folds the users into two stations."""
    return swept(event_series(spark, sf))


def swept(long):
    found = point.three_sigma(report.sweep(long).withColumn("variable", F.struct("window_start", "variable")))
    return found.groupBy(F.col("variable.window_start").alias("window_start"), "station_id", F.col("variable.variable").alias("variable")).agg(
        F.count(F.lit(1)).alias("flag_count"), F.count_if(F.col("value") > F.col("expected")).alias("high_count"),
        F.count_if(F.col("value") < F.col("expected")).alias("low_count"))


@query()
def arma_residuals(spark, sf):
    return shown(model.arma_flags(long(spark, sf)))


@query()
def forecast_check(spark, sf):
    return rounded(model.forecast_check(long(spark, sf)))


@query()
def isolation_forest(spark, sf):
    return rounded(model.isolation_forest(long(spark, sf)).select("station_id", "variable", "time", "value", "score"))


@query()
def multivariate_forest(spark, sf):
    return rounded(model.multivariate_forest(a.supplier_obs(spark, sf), DETECTED))
