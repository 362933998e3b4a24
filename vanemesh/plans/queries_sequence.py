"""Series alignment and sub-sequence queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DETECTED
from ..operators import gaps, point, report, subseq
from ..operators.scale import settle
from ..sources import adapters as a
from ..sources import tables
from .queries_detect import EVENT_FLAGS, SQL_HEAD, event_series, long
from .registry import query, rounded

M = 13
SERIES = ["station_id", "variable"]


def fill_sql(source: str, keys: str, limit: int = 2) -> str:
    """CTEs up to ``filled``: linear fill of at most ``limit`` rows from a reading on both sides."""
    before = "OVER (PARTITION BY {0} ORDER BY time ROWS UNBOUNDED PRECEDING)".format(keys)
    after = "OVER (PARTITION BY {0} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)".format(keys)
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY time) AS rn, epoch_us(time) AS us FROM {source}),
  sides AS (SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) {before} AS pi, last_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) {before} AS pt,
    last_value(value IGNORE NULLS) {before} AS pv, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) {after} AS ni,
    first_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) {after} AS nt, first_value(value IGNORE NULLS) {after} AS nv FROM numbered),
  filled AS (SELECT *, CASE WHEN value IS NOT NULL THEN value
    WHEN coalesce(rn - pi <= {limit}, false) OR coalesce(ni - rn <= {limit}, false) THEN
      CASE WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * ((us - pt) / (nt - pt)) ELSE coalesce(pv, nv) END END AS filled FROM sides)"""


_GRID = """grid AS (SELECT t.variable, t.time, m.station_id, l.value
  FROM (SELECT DISTINCT variable, time FROM long) t JOIN (SELECT DISTINCT variable, station_id FROM long) m ON t.variable = m.variable
  LEFT JOIN long l ON l.variable = t.variable AND l.time = t.time AND l.station_id = m.station_id)"""
_HOURLY = a.with_sql(a.HOURLY, a.long_sql("hourly"), _GRID)


def hourly_grid(spark, sf):
    return gaps.union_grid(tables.long_form(a.hourly(spark, sf), DETECTED))


@query(_HOURLY + "SELECT * FROM grid")
def union_grid(spark, sf):
    return hourly_grid(spark, sf)


@query(_HOURLY.rstrip() + ", " + fill_sql("grid", "station_id, variable") + """
  SELECT station_id, variable, time, value, round(filled, 6) AS filled FROM filled""")
def interpolate_gaps(spark, sf):
    filled = gaps.fill_gaps(hourly_grid(spark, sf), SERIES)
    return filled.select(*SERIES, "time", "value", F.round("filled", 6).alias("filled"))


@query(_HOURLY.rstrip() + ", " + fill_sql("grid", "station_id, variable", 3) + """
  SELECT station_id, variable, time, round(coalesce(CASE WHEN rn - pi <= 3 THEN filled END, pv), 6) AS filled FROM filled""")
def interpolate_forward(spark, sf):
    """Forward only, at most three rows, then the last reading."""
    filled = gaps.fill_gaps(hourly_grid(spark, sf), SERIES, 3, both=False, forward_rest=True)
    return filled.select(*SERIES, "time", F.round("filled", 6).alias("filled"))


_INDEXED = """ix AS (SELECT station_id, variable, time, value, row_number() OVER (PARTITION BY station_id, variable ORDER BY time) - 1 AS i,
  count(*) OVER (PARTITION BY station_id, variable) AS n FROM long WHERE value IS NOT NULL)"""


def indexed(spark, sf):
    return subseq.index_series(long(spark, sf))


@query(SQL_HEAD.rstrip() + f""", {_INDEXED}, head AS (SELECT *, value - avg(value) OVER (PARTITION BY station_id, variable) AS z FROM ix),
  ac AS (SELECT x.station_id, x.variable, y.i - x.i AS lag, sum(x.z * y.z) AS c, any_value(x.n // 2) AS half FROM head x JOIN head y
    ON x.station_id = y.station_id AND x.variable = y.variable AND y.i - x.i BETWEEN 3 AND least(400, x.n // 2) GROUP BY ALL),
  near AS (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM ac WINDOW w AS (PARTITION BY station_id, variable ORDER BY lag)),
  peak AS (SELECT station_id, variable, arg_max(lag, c) AS lag FROM near WHERE c > before AND c > after GROUP BY ALL),
  sz AS (SELECT station_id, variable, count(*) AS n FROM ix GROUP BY ALL),
  w AS (SELECT station_id, variable, n, CAST(CASE WHEN n >= 20 AND lag BETWEEN 3 AND 300 THEN lag ELSE least(100, n // 4) END AS INTEGER) AS acf_window
    FROM sz LEFT JOIN peak USING (station_id, variable))
  SELECT *, CAST(greatest(4, least(acf_window, n // 3)) AS INTEGER) AS m FROM w""")
def acf_window(spark, sf):
    return subseq.auto_windows(indexed(spark, sf))


_MARKED = """ix AS (SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY time) - 1 AS i FROM series),
  marked AS (SELECT station_id, variable, i FROM ix WHERE value > 100),
  isl AS (SELECT *, sum(starts) OVER (PARTITION BY station_id, variable ORDER BY i) AS island FROM (
    SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY station_id, variable ORDER BY i) <= 3 THEN 0 ELSE 1 END AS starts FROM marked))"""


@query(EVENT_FLAGS.rsplit(", flagged AS", 1)[0] + ", " + _MARKED + """
  SELECT station_id, variable, min(i) AS start_idx, max(i) AS end_idx, count(*) AS marks, max(i) - min(i) + 1 AS length
  FROM isl GROUP BY station_id, variable, island""")
def merge_events(spark, sf):
    rows = subseq.index_series(event_series(spark, sf))
    return subseq.merge_events(rows.where(F.col("value") > 100), SERIES, gap=3, part_rows=64)


@query(SQL_HEAD.rstrip() + f""", {_INDEXED} SELECT station_id, variable, i AS idx, array_to_string(f, ',') AS features FROM (
  SELECT *, list(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY station_id, variable ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS f FROM ix)
  WHERE i <= n - 6""")
def sliding_features(spark, sf):
    rows = indexed(spark, sf).withColumn("value", F.floor(F.col("value") * 1000).cast("long"))
    found = subseq.sliding_features(rows, 6, part_rows=100)
    return found.withColumn("features", F.concat_ws(",", F.col("features").cast("array<string>")))


# The profile of windows of 13 readings; windows and products as lists.
_PROFILE = SQL_HEAD.rstrip() + f""", {_INDEXED},
  win AS (SELECT * FROM (SELECT *, list(value) OVER (PARTITION BY station_id, variable ORDER BY i ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING) AS x FROM ix)
    WHERE i <= n - {M} AND n >= 3 * {M}),
  cen AS (SELECT *, list_transform(x, lambda v: v - list_avg(x)) AS c, list_min(x) = list_max(x) AS flat FROM win),
  unit AS (SELECT station_id, variable, i, n, flat, CASE WHEN flat THEN c ELSE list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) END AS u FROM cen),
  prof AS (SELECT p.station_id, p.variable, p.i, any_value(p.n) AS n, min(CASE WHEN p.flat AND q.flat THEN 0 WHEN p.flat OR q.flat THEN sqrt({M})
      ELSE sqrt(greatest(2 * {M} * (1 - greatest(least(list_dot_product(p.u, q.u), 1), -1)), 0)) END) AS profile
    FROM unit p JOIN unit q ON p.station_id = q.station_id AND p.variable = q.variable AND abs(p.i - q.i) > {-(-M // 4)} GROUP BY ALL)"""
_SCORED = _PROFILE + f""", span AS (SELECT station_id, variable, min(profile) AS lo, max(profile) AS hi FROM prof GROUP BY ALL),
  sc AS (SELECT station_id, variable, i, n, profile, CASE WHEN hi > lo THEN (profile - lo) / (hi - lo) ELSE 0 END AS score FROM prof JOIN span USING (station_id, variable)),
  cut AS (SELECT station_id, variable, quantile_cont(score, 0.95) AS threshold FROM sc GROUP BY ALL)"""


def profiled(spark, sf):
    rows = settle(indexed(spark, sf), "indexed")
    return rows, subseq.matrix_profile(rows, subseq.fixed_windows(rows, M))


@query(_PROFILE + " SELECT station_id, variable, i AS idx, round(profile, 6) AS profile FROM prof")
def matrix_profile(spark, sf):
    return rounded(profiled(spark, sf)[1].select(*SERIES, "idx", "profile"))


@query(_SCORED + f""" SELECT station_id, variable, ix.i AS idx, round(sc.score, 6) AS score FROM ix
  JOIN sc ON sc.station_id = ix.station_id AND sc.variable = ix.variable AND sc.i = greatest(0, least(ix.i - {(M - 1) // 2}, ix.n - {M}))""".replace(
    "SELECT station_id, variable, ix.i", "SELECT ix.station_id, ix.variable, ix.i"))
def point_scores(spark, sf):
    return rounded(subseq.point_scores(subseq.scored_profile(profiled(spark, sf)[1])))


_EVENTS = _SCORED + f""", hit AS (SELECT station_id, variable, i + {(M - 1) // 2} AS pos FROM sc JOIN cut USING (station_id, variable) WHERE score > threshold),
  isl AS (SELECT *, sum(starts) OVER (PARTITION BY station_id, variable ORDER BY pos) AS island FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY station_id, variable ORDER BY pos) <= {M} THEN 0 ELSE 1 END AS starts FROM hit)),
  ev AS (SELECT station_id, variable, min(pos) AS start_idx, max(pos) AS end_idx FROM isl GROUP BY station_id, variable, island)"""


@query(_EVENTS + f""" SELECT e.station_id, e.variable, start_idx, end_idx, end_idx - start_idx + 1 AS length, s.time AS start_time, t.time AS end_time,
    CAST(printf('%.1f', (epoch(t.time) - epoch(s.time)) / 3600) AS DOUBLE) AS duration_hours, CASE WHEN end_idx - start_idx + 1 > 20 THEN 'high' ELSE 'medium' END AS severity,
    {M} AS window_length, round(threshold, 6) AS threshold
  FROM ev e JOIN ix s ON s.station_id = e.station_id AND s.variable = e.variable AND s.i = start_idx
    JOIN ix t ON t.station_id = e.station_id AND t.variable = e.variable AND t.i = end_idx
    JOIN cut c ON c.station_id = e.station_id AND c.variable = e.variable""")
def profile_events(spark, sf):
    rows, profile = profiled(spark, sf)
    events = subseq.profile_events(rows, settle(subseq.scored_profile(profile), "scored"))
    return events.select(*SERIES, "start_idx", "end_idx", "length", "start_time", "end_time", "duration_hours", "severity",
                         "window_length", F.round("threshold", 6).alias("threshold"))


@query(_EVENTS + f""", ne AS (SELECT station_id, variable, count(*) AS num_events FROM ev GROUP BY ALL)
  SELECT station_id, variable, {M} AS window_length, round(threshold, 6) AS threshold, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score,
    coalesce(any_value(num_events), 0) AS num_events FROM sc JOIN cut USING (station_id, variable) LEFT JOIN ne USING (station_id, variable)
  GROUP BY station_id, variable, threshold""")
def profile_summary(spark, sf):
    rows, profile = profiled(spark, sf)
    scored = settle(subseq.scored_profile(profile), "scored")
    return rounded(subseq.profile_summary(scored, subseq.profile_events(rows, scored)))


def _discord_sql(rounds: int = 3) -> str:
    """Each round takes the highest window that overlaps none of those before."""
    out, chosen = _PROFILE, []
    for r in range(1, rounds + 1):
        free = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM d{c} WHERE d{c}.station_id = p.station_id AND d{c}.variable = p.variable AND abs(d{c}.i - p.i) < {M})"
            for c in chosen)
        out += f""", d{r} AS MATERIALIZED (SELECT station_id, variable, i, profile FROM (SELECT p.*, row_number() OVER (
          PARTITION BY station_id, variable ORDER BY round(profile, 9) DESC, i DESC) AS r FROM prof p WHERE true{free}) WHERE r = 1)"""
        chosen.append(r)
    return out + " UNION ALL ".join(
        f"{' ' if r == 1 else ''}SELECT station_id, variable, {r} AS rank, i AS start_idx, i + {M} AS end_idx, round(round(profile, 9), 6) AS score FROM d{r}"
        for r in chosen)


@query(_discord_sql())
def discords(spark, sf):
    profile = profiled(spark, sf)[1].withColumn("profile", F.round("profile", 9))
    return rounded(subseq.discords(profile, 3))


@query()
def subsequence_events(spark, sf):
    """The whole chain with the window chosen by autocorrelation."""
    return rounded(subseq.subsequence_events(long(spark, sf)))


@query()
def comprehensive_report(spark, sf):
    obs = a.supplier_obs(spark, sf)
    rows = tables.long_form(obs)
    points = point.three_sigma(rows)
    events = subseq.subsequence_events(rows)
    full = report.comprehensive(a.stations(spark, sf), obs, points, events)
    return full.withColumn("point_anomalies", F.to_json("point_anomalies")).withColumn(
        "subsequence_anomalies", F.to_json("subsequence_anomalies")).withColumn(
        "point_variables", F.array_join("point_variables", ",")).withColumn(
        "event_variables", F.array_join("event_variables", ","))
