"""Neighbours, spatial verification and the reports built on it, over the driver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import gaps, point, report, spatial, trend, views
from ..operators.scale import settle
from ..sources import adapters as a
from .queries_detect import _mad, _three_sigma, event_series, long
from .queries_sequence import fill_sql
from .registry import query, rounded

RADIUS = timedelta(days=70)
BASE = a.with_sql(a.STATIONS, a.edges_sql())
FULL = a.with_sql(a.STATIONS, a.edges_sql(), a.SUPPLIER_OBS, a.long_sql("supplier_obs"))


def edges(spark, sf):
    return spatial.neighbors(a.stations(spark, sf))


@query(BASE + "SELECT src, dst, round(dist_km, 6) AS dist_km, elev_diff FROM edges")
def neighbors(spark, sf):
    return rounded(edges(spark, sf))


@query(a.with_sql(a.STATIONS, a.edges_sql(max_km=50)) + """SELECT src, dst, round(dist_km, 6) AS dist_km, elev_diff FROM edges WHERE src < dst""")
def neighbor_links(spark, sf):
    """Links of the map: 50 km, each pair once."""
    return rounded(spatial.links(spatial.neighbors(a.stations(spark, sf), max_km=50)))


@query(a.with_sql("""holed AS (SELECT * REPLACE (CASE WHEN CAST(station_id AS BIGINT) % 5 = 0 THEN NULL ELSE elevation END AS elevation) FROM ("""
                  + a.STATIONS.split("AS (", 1)[1].rsplit(")", 1)[0] + "))") + """SELECT p.station_id AS src, q.station_id AS dst
  FROM holed p JOIN holed q ON p.station_id <> q.station_id WHERE abs(p.elevation - q.elevation) <= 300
    AND 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians(q.latitude) - radians(p.latitude)) / 2), 2)
      + cos(radians(p.latitude)) * cos(radians(q.latitude)) * pow(sin((radians(q.longitude) - radians(p.longitude)) / 2), 2))) <= 60""")
def neighbors_known_elevation(spark, sf):
    """Other radius and elevation limit; an unknown elevation fails the test."""
    s = a.stations(spark, sf)
    s = s.withColumn("elevation", F.when(F.col("station_id").cast("long") % 5 != 0, F.col("elevation")))
    return spatial.neighbors(s, 60, 300, "fail").select("src", "dst")


@query(BASE + """SELECT s.station_id, count(e.dst) AS degree FROM stations s LEFT JOIN edges e ON e.src = s.station_id GROUP BY 1""")
def neighbor_degree(spark, sf):
    return spatial.degrees(a.stations(spark, sf), edges(spark, sf))


@query(BASE + """SELECT count(*) AS station_count, CAST(sum(degree) // 2 AS BIGINT) AS connection_count, round(avg(degree), 6) AS avg_degree,
  max(degree) AS max_degree, min(degree) AS min_degree, count(CASE WHEN degree = 0 THEN 1 END) AS isolated_count
  FROM (SELECT s.station_id, count(e.dst) AS degree FROM stations s LEFT JOIN edges e ON e.src = s.station_id GROUP BY 1)""")
def degree_summary(spark, sf):
    return rounded(spatial.degree_summary(a.stations(spark, sf), edges(spark, sf)))


_LATEST = """latest AS (SELECT station_id, variable, max(time) AS time, arg_max(value, time) AS value FROM long WHERE value IS NOT NULL GROUP BY ALL)"""


def _snapshot_sql(adjust: str, min_neighbors: int, scale: float) -> str:
    return f"""{_LATEST},
  nb AS (SELECT e.src AS station_id, l.variable, {adjust} AS v FROM edges e JOIN latest l ON l.station_id = e.dst),
  med AS (SELECT station_id, variable, median(v) AS neighbor_median, stddev_pop(v) AS sd, count(*) AS n_neighbors FROM nb GROUP BY ALL HAVING count(*) >= {min_neighbors}),
  mad AS (SELECT station_id, variable, median(abs(v - neighbor_median)) AS mad FROM nb JOIN med USING (station_id, variable) GROUP BY ALL),
  judged AS (SELECT l.station_id, l.variable, l.value, neighbor_median, n_neighbors,
    abs(l.value - neighbor_median) / ({scale} * CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1e-6 END) AS deviation
    FROM latest l JOIN med USING (station_id, variable) JOIN mad USING (station_id, variable))"""


_BAR = "CASE WHEN l.variable = 'bar' THEN l.value + e.elev_diff / 10 * 1.2 ELSE l.value END"
_BOTH = "CASE WHEN l.variable = 'bar' THEN l.value + e.elev_diff / 10 * 1.2 WHEN l.variable = 'temp_out' THEN l.value + e.elev_diff / 100 * 0.65 ELSE l.value END"


def latest(spark, sf):
    return views.latest_values(long(spark, sf))


@query(FULL.rstrip() + ", " + _snapshot_sql(_BAR, 2, 1.4826) + """ SELECT station_id, variable, round(value, 6) AS value, round(neighbor_median, 6) AS neighbor_median,
  n_neighbors, round(deviation, 6) AS deviation, deviation > 3 AS is_outlier FROM judged""")
def spatial_snapshot(spark, sf):
    return rounded(spatial.snapshot_outliers(latest(spark, sf), edges(spark, sf)).drop("time"))


@query(FULL.rstrip() + ", " + _snapshot_sql(_BOTH, 3, 1.4826) + """ SELECT station_id, variable, n_neighbors, round(deviation, 6) AS deviation FROM judged WHERE deviation > 2""")
def spatial_snapshot_adjusted(spark, sf):
    """Temperature adjusted for elevation too, other limits."""
    s = spatial.snapshot_outliers(latest(spark, sf), edges(spark, sf), 2.0, 3, ("temp", "temp_out"))
    return rounded(s.where("is_outlier").select("station_id", "variable", "n_neighbors", "deviation"))


@query(FULL.rstrip() + ", " + _snapshot_sql(_BAR, 1, 1.0) + """ SELECT station_id, variable, round(deviation, 6) AS deviation,
  CASE WHEN deviation > 3 THEN 'critical_failure' ELSE 'weather_event' END AS distance_type FROM judged""")
def distance_class(spark, sf):
    d = spatial.distance_class(latest(spark, sf), edges(spark, sf))
    return rounded(d.select("station_id", "variable", "deviation", "distance_type"))


_FLAGGED = f"flagged AS ({_three_sigma()})"


@query(FULL.rstrip() + f""", {_FLAGGED} SELECT s.station_id, s.station_name_en, s.latitude, s.longitude, count(f.time) AS anomaly_count,
  CASE WHEN count(f.time) > 0 THEN 'anomalous' ELSE 'normal' END AS status FROM stations s LEFT JOIN flagged f USING (station_id) GROUP BY ALL""")
def map_nodes(spark, sf):
    nodes = spatial.map_nodes(a.stations(spark, sf), point.three_sigma(long(spark, sf)))
    return nodes.select("station_id", "station_name_en", "latitude", "longitude", "anomaly_count", "status")


@query(FULL.rstrip() + f""", {_FLAGGED} SELECT status, count(*) AS station_count FROM (SELECT CASE WHEN count(f.time) > 0 THEN 'anomalous' ELSE 'normal' END AS status
  FROM stations s LEFT JOIN flagged f USING (station_id) GROUP BY s.station_id) GROUP BY 1""")
def marker_counts(spark, sf):
    nodes = spatial.map_nodes(a.stations(spark, sf), point.three_sigma(long(spark, sf)))
    return nodes.groupBy("status").agg(F.count(F.lit(1)).alias("station_count"))


@query(a.with_sql(a.STATIONS) + """SELECT station_id, 'Feature' AS kind, round(longitude, 6) AS lon, round(latitude, 6) AS lat, station_name_en AS name FROM stations""")
def map_features(spark, sf):
    """The features are GeoJSON text; their fields are read back."""
    text = a.stations(spark, sf).select("station_id", spatial.point_feature(["station_id", "station_name_en"]).alias("f"))
    get = lambda path: F.get_json_object("f", path)
    return rounded(text.select(
        "station_id", get("$.type").alias("kind"), get("$.geometry.coordinates[0]").cast("double").alias("lon"),
        get("$.geometry.coordinates[1]").cast("double").alias("lat"), get("$.properties.station_name_en").alias("name")))


# --- trend verification ----------------------------------------------------------------------------------------

_DAYS = RADIUS.days
_A = "a_station, variable, a_time"


def _aligned_sql(min_points: int = 5, pairwise: bool = False) -> str:
    use = "filled IS NOT NULL AND target IS NOT NULL" if pairwise else "complete"
    return f"""asked AS (SELECT station_id AS a_station, variable, time AS a_time FROM flagged),
  members AS (SELECT q.*, e.dst AS member FROM asked q JOIN edges e ON e.src = q.a_station
    UNION ALL SELECT q.*, q.a_station FROM asked q WHERE q.a_station IN (SELECT src FROM edges)),
  win AS (SELECT m.*, l.time, l.value FROM members m JOIN long l ON l.station_id = m.member AND l.variable = m.variable
    AND l.time BETWEEN m.a_time - INTERVAL {_DAYS} DAY AND m.a_time + INTERVAL {_DAYS} DAY),
  grid AS (SELECT t.*, p.member, w.value FROM (SELECT DISTINCT {_A}, time FROM win) t JOIN (SELECT DISTINCT {_A}, member FROM win) p USING ({_A})
    LEFT JOIN win w USING ({_A}, member, time)),
  {fill_sql("grid", _A + ", member")},
  al AS (SELECT *, max(CASE WHEN member = a_station THEN filled END) OVER (PARTITION BY {_A}, time) AS target,
    count(filled) OVER (PARTITION BY {_A}, time) = count(*) OVER (PARTITION BY {_A}, time) AS complete FROM filled),
  pair AS (SELECT {_A}, member, count(CASE WHEN {use} THEN 1 END) AS points, covar_pop(CASE WHEN {use} THEN target END, CASE WHEN {use} THEN filled END) AS cov,
    stddev_pop(CASE WHEN {use} THEN target END) AS sx, stddev_pop(CASE WHEN {use} THEN filled END) AS sy FROM al GROUP BY ALL),
  pc AS (SELECT {_A}, member, points, CASE WHEN member <> a_station AND sx * sy > 1e-15 THEN cov / (sx * sy) END AS corr FROM pair),
  jd AS (SELECT {_A}, bool_or(member = a_station) AS own, max(points) AS points, median(CASE WHEN points >= {min_points} THEN corr END) AS median_corr,
    max(CASE WHEN points >= {min_points} THEN corr END) AS max_corr, count(CASE WHEN points >= {min_points} THEN corr END) AS n_neighbors FROM pc GROUP BY ALL),
  st AS (SELECT f.station_id, f.variable, f.time, f.value, f.expected, f.deviation, coalesce(j.points, 0) AS points, j.median_corr, j.max_corr, coalesce(j.n_neighbors, 0) AS n_neighbors,
    CASE WHEN f.station_id NOT IN (SELECT station_id FROM stations) THEN 'station_not_found' WHEN f.station_id NOT IN (SELECT src FROM edges) THEN 'no_neighbors'
      WHEN NOT coalesce(own, false) THEN 'no_data' WHEN coalesce(j.points, 0) < {min_points} THEN 'insufficient_points'
      WHEN coalesce(j.n_neighbors, 0) = 0 THEN 'no_valid_correlations' ELSE 'success' END AS status
    FROM flagged f LEFT JOIN jd j ON j.a_station = f.station_id AND j.variable = f.variable AND j.a_time = f.time),
  verdicts AS (SELECT *, CASE WHEN status <> 'success' THEN 'unverified' WHEN median_corr > 0.6 OR max_corr > 0.8 THEN 'weather_event'
    WHEN median_corr < 0.3 THEN 'critical_failure' ELSE 'warning' END AS type FROM st)"""


VERDICTS = FULL.rstrip() + f", {_FLAGGED}, " + _aligned_sql()


def readings(spark, sf):
    """The readings of the suppliers, summed up once for all steps."""
    return settle(long(spark, sf), "readings")


def verdicts(spark, sf, rows=None, named=(), **options):
    rows = readings(spark, sf) if rows is None else rows
    return trend.verify(point.three_sigma(rows), rows, edges(spark, sf), a.stations(spark, sf), RADIUS, named=named, **options)


_VERDICT_COLUMNS = """station_id, variable, time, status, type, points, n_neighbors, round(median_corr, 6) AS median_corr, round(max_corr, 6) AS max_corr"""
_SHOWN = ("station_id", "variable", "time", "status", "type", "points", "n_neighbors", "median_corr", "max_corr")


@query(VERDICTS + f""" SELECT {_VERDICT_COLUMNS}, CASE type WHEN 'weather_event' THEN 'Weather Event' WHEN 'critical_failure' THEN 'Device Failure'
  WHEN 'warning' THEN 'Suspected' ELSE 'Unverified Anomaly' END AS label FROM verdicts""")
def trend_verify(spark, sf):
    return rounded(verdicts(spark, sf).select(*_SHOWN, "label"))


@query(FULL.rstrip() + f", {_FLAGGED}, " + _aligned_sql(8, True) + f" SELECT {_VERDICT_COLUMNS} FROM verdicts")
def trend_verify_pairwise(spark, sf):
    """Each neighbour over the times it shares with the station, other limits."""
    return rounded(verdicts(spark, sf, alignment="pairwise", min_points=8).select(*_SHOWN))


@query(VERDICTS + """, ids AS (SELECT a_station, variable, a_time, string_agg(member, ',' ORDER BY member) AS neighbor_ids FROM pc
    WHERE points >= 5 AND corr IS NOT NULL GROUP BY ALL)
  SELECT v.station_id, v.variable, v.time, v.n_neighbors, coalesce(i.neighbor_ids, '') AS neighbor_ids FROM verdicts v
  LEFT JOIN ids i ON i.a_station = v.station_id AND i.variable = v.variable AND i.a_time = v.time WHERE v.type IN ('critical_failure', 'warning')""")
def failure_neighbors(spark, sf):
    """Device failures and suspects with the neighbours that the verdict rests on."""
    kinds = "critical_failure", "warning"
    found = verdicts(spark, sf, named=kinds).where(F.col("type").isin(*kinds))
    return found.select("station_id", "variable", "time", "n_neighbors", F.array_join("neighbor_ids", ",").alias("neighbor_ids"))


@query(FULL.rstrip() + f", {_FLAGGED}, " + _aligned_sql(19) + """,
  last AS (SELECT w.a_station, w.variable, w.a_time, w.member, arg_max(w.value, w.time) AS nb FROM win w JOIN verdicts v ON v.station_id = w.a_station
      AND v.variable = w.variable AND v.time = w.a_time AND v.status IN ('insufficient_points', 'no_valid_correlations')
    WHERE w.member <> w.a_station AND w.time <= w.a_time AND w.value IS NOT NULL GROUP BY ALL),
  centre AS (SELECT a_station, variable, a_time, median(nb) AS m, stddev_pop(nb) AS sd, count(*) AS n FROM last GROUP BY ALL),
  spread AS (SELECT a_station, variable, a_time, median(abs(nb - m)) AS mad FROM last JOIN centre USING (a_station, variable, a_time) GROUP BY ALL),
  far AS (SELECT c.*, CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1e-6 END AS unit FROM centre c JOIN spread USING (a_station, variable, a_time))
  SELECT v.station_id, v.variable, v.time, v.status, f.n AS distance_neighbors, round(f.m, 6) AS neighbor_median, round(abs(v.value - f.m) / f.unit, 6) AS distance,
    CASE WHEN abs(v.value - f.m) / f.unit > 3 THEN 'critical_failure' WHEN f.m IS NOT NULL THEN 'weather_event' END AS distance_type
  FROM verdicts v LEFT JOIN far f ON f.a_station = v.station_id AND f.variable = v.variable AND f.a_time = v.time
  WHERE v.status IN ('insufficient_points', 'no_valid_correlations')""")
def trend_distance_evidence(spark, sf):
    """Anomalies without a correlation (19 points or more are asked for), judged by their neighbours' last readings."""
    rows = readings(spark, sf)
    found = trend.distance_evidence(verdicts(spark, sf, rows, min_points=19), rows, edges(spark, sf), RADIUS)
    return rounded(found.where(F.col("status").isin(*trend.WITHOUT_CORRELATION)).select(
        "station_id", "variable", "time", "status", "distance_neighbors", "neighbor_median", "distance", "distance_type"))


@query(FULL.rstrip() + """, placed AS (SELECT *, time_bucket(INTERVAL 28 DAY, time, TIMESTAMP '1970-01-01') AS bucket FROM long),
  members AS (SELECT DISTINCT station_id AS center, station_id AS member FROM long UNION SELECT src, dst FROM edges),
  r AS (SELECT m.center, p.variable, p.bucket, m.member, p.time, p.value FROM placed p JOIN members m ON m.member = p.station_id),
  grid AS (SELECT t.*, q.member, r.value FROM (SELECT DISTINCT center, variable, bucket, time FROM r) t
    JOIN (SELECT DISTINCT center, variable, bucket, member FROM r) q USING (center, variable, bucket) LEFT JOIN r USING (center, variable, bucket, member, time))
  SELECT center, variable, bucket, member, count(*) AS times, count(value) AS readings, count(*) - count(value) AS gaps FROM grid GROUP BY ALL""")
def neighborhood_grid(spark, sf):
    """Members of every neighbourhood on the times of their 28-day windows: how many times, readings and gaps each has."""
    return gaps.grid_counts(gaps.neighborhood_grid(readings(spark, sf), edges(spark, sf), "28 days"))


@query(VERDICTS + """ SELECT p.a_station, p.variable, p.a_time, p.member, p.points, round(p.corr, 6) AS corr FROM pc p WHERE p.member <> p.a_station""")
def trend_pairs(spark, sf):
    rows = readings(spark, sf)
    windows = trend.anomaly_windows(point.three_sigma(rows), rows, edges(spark, sf), RADIUS)
    pairs = trend.pair_correlations(windows).where(F.col("member") != F.col("a_station"))
    return rounded(pairs.select("a_station", "variable", "a_time", "member", "points", "corr"))


@query(VERDICTS + f""", failed AS (SELECT station_id AS a_station, variable, time AS a_time FROM verdicts WHERE type = 'critical_failure'),
  few AS (SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM edges) WHERE rank <= 5)
  SELECT a_station AS station_id, variable, a_time AS anomaly_time, time, member, CASE WHEN member = a_station THEN 'target' ELSE 'neighbor' END AS role,
    CAST(coalesce(few.rank, 0) AS INTEGER) AS rank, round(filled, 8) AS value
  FROM al JOIN failed USING ({_A}) LEFT JOIN few ON few.src = a_station AND few.dst = member
  WHERE complete AND (member = a_station OR few.rank IS NOT NULL)""")
def neighbor_table(spark, sf):
    """Readings around device failures, next to the first five neighbours."""
    rows = readings(spark, sf)
    failed = verdicts(spark, sf, rows).where(F.col("type") == "critical_failure").select("station_id", "variable", "time")
    return rounded(trend.comparison_table(failed, rows, edges(spark, sf), RADIUS), 8)


@query(FULL.rstrip() + """, joint AS (SELECT e.src, e.dst, x.variable, e.dist_km, x.value AS x, y.value AS y FROM edges e
    JOIN long x ON x.station_id = e.src JOIN long y ON y.station_id = e.dst AND y.variable = x.variable AND y.time = x.time
    WHERE x.value IS NOT NULL AND y.value IS NOT NULL)
  SELECT src, dst, variable, round(max(dist_km), 6) AS dist_km, count(*) AS points, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS corr
  FROM joint GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def pair_correlation(spark, sf):
    return rounded(trend.station_pair_correlations(long(spark, sf), edges(spark, sf)))


@query(a.with_sql(a.EVENTS_LONG, """series AS (SELECT CAST(CAST(station_id AS BIGINT) % 14 AS VARCHAR) AS station_id, variable, time, value FROM events_long)"""
                  ).rstrip() + f""", flagged AS ({_three_sigma('series')}) SELECT variable, time_bucket(INTERVAL 1 DAY, time, TIMESTAMP '1970-01-01') AS bucket,
  count(DISTINCT station_id) AS station_count, count(*) AS flag_count,
  CASE WHEN count(DISTINCT station_id) >= 3 THEN 'weather' WHEN count(DISTINCT station_id) = 1 THEN 'device' ELSE 'unclear' END AS hint FROM flagged GROUP BY 1, 2""")
def event_breadth(spark, sf):
    return trend.event_breadth(point.three_sigma(event_series(spark, sf)), "1 day")


_CLASS = "CASE type WHEN 'critical_failure' THEN 'device_failure' WHEN 'warning' THEN 'suspected' ELSE type END"


@query(VERDICTS + f" SELECT {_CLASS} AS classification, count(*) AS anomaly_count FROM verdicts GROUP BY 1")
def class_breakdown(spark, sf):
    return report.class_breakdown(verdicts(spark, sf))


@query(VERDICTS + """ SELECT station_id, count(*) AS alert_count, string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables
  FROM verdicts WHERE type = 'critical_failure' GROUP BY 1""")
def alerts(spark, sf):
    return report.alerts(verdicts(spark, sf)).withColumn("variables", F.array_join("variables", ","))


@query(VERDICTS + f""" SELECT strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, v.station_id, station_name_en AS station_name, variable, round(value, 8) AS actual,
  round(expected, 8) AS expected, round(deviation, 8) AS deviation, '3sigma' AS method, {_CLASS} AS classification, round(median_corr, 8) AS correlation, n_neighbors AS neighbors
  FROM verdicts v LEFT JOIN stations USING (station_id)""")
def anomaly_rows(spark, sf):
    return rounded(report.anomaly_rows(verdicts(spark, sf), a.stations(spark, sf)), 8)


@query(VERDICTS + """ SELECT count(*) AS total, count(CASE WHEN found IS NULL THEN 1 END) AS normal, count(found) AS anomalous,
  CAST(coalesce(sum(failures), 0) AS BIGINT) AS failures, CASE WHEN sum(failures) > 0 THEN 'critical' ELSE 'normal' END AS status FROM stations
  LEFT JOIN (SELECT station_id, true AS found, count(CASE WHEN type = 'critical_failure' THEN 1 END) AS failures FROM verdicts GROUP BY 1) USING (station_id)""")
def dashboard(spark, sf):
    return report.dashboard(a.stations(spark, sf), verdicts(spark, sf))


@query(VERDICTS + f""" SELECT station_id AS station, variable, time, {_CLASS} AS type, round(value, 6) AS value, round(expected, 6) AS expected,
  CASE WHEN type = 'critical_failure' THEN 'high' ELSE 'low' END AS severity FROM verdicts""")
def dashboard_alerts(spark, sf):
    return rounded(report.dashboard_alerts(verdicts(spark, sf)))


@query(VERDICTS + f""", known AS (SELECT station_id, variable, time, CASE WHEN CAST(station_id AS BIGINT) % 2 = 0 THEN 'weather_event' ELSE 'critical_failure' END AS expected_type
    FROM ({_mad(1.0, 3.5)})),
  c AS (SELECT count(CASE WHEN v.type = k.expected_type THEN 1 END) AS tp, count(CASE WHEN v.type <> k.expected_type THEN 1 END) AS fp,
    count(CASE WHEN v.type IS NULL THEN 1 END) AS fn FROM known k LEFT JOIN verdicts v USING (station_id, variable, time)),
  q AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
  SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM q""")
def detection_quality(spark, sf):
    """Labels by another rule and by parity of the station, so that all three outcomes occur."""
    rows = readings(spark, sf)
    labels = point.raw_mad(rows).select("station_id", "variable", "time", F.when(
        F.col("station_id").cast("long") % 2 == 0, "weather_event").otherwise("critical_failure").alias("expected_type"))
    return rounded(report.detection_quality(labels, verdicts(spark, sf, rows)))
