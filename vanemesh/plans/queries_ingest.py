"""Snapshot parsing, storing and streaming over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, runs
from ..session import run_folder
from ..sources import adapters as a
from ..sources import geojson
from ..streaming import aggregates, late, panes, sensors
from ..streaming import ingest as stream_store
from .registry import SQL, query, rounded

BASE = a.with_sql(a.FEATURES)
_FIRST = """rowsx AS (SELECT *, make_timestamp(ts * 1000000) AS time FROM features WHERE ts > 0),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, station_id ORDER BY event_id) AS r FROM rowsx) WHERE r = 1)"""


def features(spark, sf):
    return geojson.features(a.geojson(spark, sf))


@query(BASE + "SELECT event_id, station_id, make_timestamp(ts * 1000000) AS time, temp_out, rain FROM features WHERE ts > 0")
def geojson_observations(spark, sf):
    return geojson.observations(features(spark, sf)).select("event_id", "station_id", "time", "temp_out", "rain")


@query(BASE + """SELECT event_id, station_id, station_name_en, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, elevation FROM features""")
def geojson_stations(spark, sf):
    s = geojson.stations(features(spark, sf))
    return rounded(s.select("event_id", "station_id", "station_name_en", "latitude", "longitude", "elevation"))


def replayed(spark, sf):
    """All observations of the snapshots, and a third of them a second time with another value."""
    rows = geojson.observations(features(spark, sf)).drop("feature_no").withColumn("attempt", F.lit(0))
    again = rows.where(F.col("event_id") % 3 == 0).withColumn("attempt", F.lit(1)).withColumn("temp_out", F.lit(-1.0))
    return rows.unionByName(again)


@query(BASE.rstrip() + f", {_FIRST} SELECT event_id, station_id, time, temp_out, rain FROM firsts")
def ingest_dedupe(spark, sf):
    rows = ingest.first_writes(replayed(spark, sf), ["attempt", "event_id"])
    return rows.select("event_id", "station_id", "time", "temp_out", "rain")


@query(BASE.rstrip() + f""", {_FIRST} SELECT event_id, station_id, time, temp_out FROM firsts
  WHERE (time, station_id) NOT IN (SELECT (time, station_id) FROM rowsx WHERE event_id % 4 = 0)""")
def ingest_new_rows(spark, sf):
    """Every fourth event is stored already; what of all snapshots is new?"""
    rows = replayed(spark, sf)
    stored = rows.where(F.col("event_id") % 4 == 0)
    return ingest.new_rows(rows, stored, ["attempt", "event_id"]).select("event_id", "station_id", "time", "temp_out")


def sightings(spark, sf):
    s = geojson.stations(features(spark, sf))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id"))
    return s.withColumn("seen_at", at)


_SEEN = """seen AS (SELECT *, make_timestamp((1700000000 + event_id) * 1000000) AS seen_at FROM features),
  old AS (SELECT station_id, arg_max(station_name_en, event_id) AS name, arg_max(latitude, event_id) AS lat, arg_max_null(elevation, event_id) AS elev,
    min(seen_at) AS f, max(seen_at) AS l FROM seen WHERE event_id % 4 = 0 GROUP BY 1),
  fresh AS (SELECT station_id, arg_max(station_name_en, event_id) AS name, arg_max(latitude, event_id) AS lat, arg_max_null(elevation, event_id) AS elev,
    arg_min_null(elevation, event_id) AS first_elev, min(seen_at) AS f, max(seen_at) AS l FROM seen WHERE event_id % 4 <> 0 GROUP BY 1)"""


def _upsert(spark, sf, updated):
    seen = sightings(spark, sf)
    stored = ingest.station_updates(seen.where(F.col("event_id") % 4 == 0), "seen_at", ["event_id"]).select(
        "station_id", "newest.*", "first_seen", "last_seen")
    merged = ingest.upsert_stations(stored, seen.where(F.col("event_id") % 4 != 0), "seen_at", ["event_id"], updated)
    return rounded(merged.select("station_id", "station_name_en", "latitude", "elevation", "first_seen", "last_seen"))


@query(BASE.rstrip() + f""", {_SEEN} SELECT coalesce(n.station_id, o.station_id) AS station_id, coalesce(n.name, o.name) AS station_name_en,
  round(coalesce(n.lat, o.lat), 6) AS latitude, CASE WHEN n.station_id IS NOT NULL THEN n.elev ELSE o.elev END AS elevation,
  coalesce(o.f, n.f) AS first_seen, greatest(o.l, n.l) AS last_seen FROM old o FULL JOIN fresh n USING (station_id)""")
def station_upsert(spark, sf):
    return _upsert(spark, sf, ingest.STATION_VALUES)


@query(BASE.rstrip() + f""", {_SEEN} SELECT coalesce(n.station_id, o.station_id) AS station_id, coalesce(n.name, o.name) AS station_name_en,
  round(coalesce(n.lat, o.lat), 6) AS latitude, CASE WHEN o.station_id IS NOT NULL THEN o.elev ELSE n.first_elev END AS elevation,
  coalesce(o.f, n.f) AS first_seen, greatest(o.l, n.l) AS last_seen FROM old o FULL JOIN fresh n USING (station_id)""")
def station_upsert_reduced(spark, sf):
    """The other store's update: name and place only."""
    return _upsert(spark, sf, ingest.REDUCED_VALUES)


@query(BASE.rstrip() + f""", {_FIRST}, s AS (SELECT event_id % 4 AS batch, count(*) AS stations_count FROM features GROUP BY 1),
  o AS (SELECT event_id % 4 AS batch, count(*) AS observations_count FROM firsts GROUP BY 1)
  SELECT batch, 'SUCCESS' AS status, stations_count, observations_count,
    'Stored ' || observations_count || ' obs from ' || stations_count || ' stations' AS message FROM s JOIN o USING (batch)""")
def collection_log_rows(spark, sf):
    seen = features(spark, sf).withColumn("batch", F.col("event_id") % 4)
    stored = ingest.first_writes(replayed(spark, sf), ["attempt", "event_id"]).withColumn("batch", F.col("event_id") % 4)
    return ingest.log_rows(seen, stored, "batch")


# --- streaming -------------------------------------------------------------------------------------------------

def event_stream(spark, sf):
    schema = a.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def reading_stream(spark, sf):
    return event_stream(spark, sf).select(
        (F.col("user_id") % 14).cast("string").alias("station_id"), F.col("ts").alias("time"),
        F.col("event_type").alias("variable"), "value")


def run_to_end(stream):
    stream.awaitTermination()


def landed(spark, rows, batches: int = 3):
    """A stream of ``rows`` (event_id and more) as they land, once for each of ``batches`` shares of them in the order of event_id."""
    folder = run_folder(spark, "landed")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    place = F.floor((F.col("event_id") - low) * batches / F.lit(high - low + 1))
    for k in range(batches):
        rows.where(place == k).write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


def ingested(spark, sf, batches: int = 3, compacted: bool = False):
    """Events as snapshots, each sent twice, through the ingest in a few micro-batches of any number of files."""
    store, checkpoint = stream_store.Store(run_folder(spark, "store")), run_folder(spark, "checkpoint")
    for k, stream in enumerate(landed(spark, a.table(spark, sf, "events"), batches)):  # each run takes what is new as one micro-batch
        snapshots = stream.withColumn("value", a.snapshot_text()).select(
            "value", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("landed_at"),
            F.lit("events").alias("source"))
        run_to_end(stream_store.start_ingest(snapshots.union(snapshots), store, checkpoint))
        if compacted and k % 2:
            store.compact(spark)
    return store


@query(BASE.rstrip() + f", {_FIRST} SELECT station_id, time, temp_out, rain FROM firsts")
def stream_ingest(spark, sf):
    return ingested(spark, sf).observations(spark).select("station_id", "time", "temp_out", "rain")


@query(BASE.rstrip() + f", {_FIRST} SELECT station_id, time, temp_out, rain FROM firsts")
def stream_compacted(spark, sf):
    """The same in five micro-batches, with the store compacted after the second and the fourth."""
    return ingested(spark, sf, 5, compacted=True).observations(spark).select("station_id", "time", "temp_out", "rain")


@query(BASE.rstrip() + f""", {_FIRST}, o AS (SELECT event_id, count(*) AS n FROM firsts GROUP BY 1)
  SELECT make_timestamp((1700000000 + event_id) * 1000000) AS timestamp, 'SUCCESS' AS status, 2 AS stations_count,
    CAST(coalesce(n, 0) AS INTEGER) AS observations_count, 'Stored ' || coalesce(n, 0) || ' obs from 2 stations' AS message
  FROM features LEFT JOIN o USING (event_id)""")
def stream_log(spark, sf):
    """The collection log of the ingest: a row for each snapshot."""
    return ingested(spark, sf).log(spark).select("timestamp", "status", "stations_count", "observations_count", "message")


def _updates(spark, stream, keys):
    folder = run_folder(spark, "updates")
    run_to_end(aggregates.save_updates(stream, folder, run_folder(spark, "checkpoint")))
    saved = spark.read.parquet(folder)
    return aggregates.newest(saved.withColumn("bucket", F.col("w.start")).drop("w"), ["bucket", *keys])


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, CAST(user_id % 14 AS VARCHAR) AS station_id, count(*) AS row_count,
  round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(stddev_samp(value), 6) AS std_value FROM events GROUP BY 1, 2""")
def stream_hourly(spark, sf):
    return rounded(_updates(spark, aggregates.hourly(reading_stream(spark, sf)), ["station_id"]))


@query("""SELECT b AS bucket, CAST(user_id % 14 AS VARCHAR) AS station_id, event_type AS variable, count(value) AS n, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std
  FROM (SELECT *, time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') - to_minutes(10 * unnest(range(0, 36))) AS b FROM events) GROUP BY ALL""")
def stream_sliding(spark, sf):
    stream = aggregates.sliding(reading_stream(spark, sf))
    return rounded(_updates(spark, stream, ["station_id", "variable"]))


@query("""SELECT b AS bucket, CAST(user_id % 14 AS VARCHAR) AS station_id, event_type AS variable, count(*) AS row_count, count(*) - count(value) AS missing_count,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
  FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(unnest(range(0, 24))) AS b FROM events) GROUP BY ALL""")
def stream_profile(spark, sf):
    stream = aggregates.profile(reading_stream(spark, sf))
    out = _updates(spark, stream, ["station_id", "variable"])
    return rounded(out.select("bucket", "station_id", "variable", "row_count", "missing_count", "mean", "std", "min", "max"))


@query()
def stream_profile_panes(spark, sf):
    """The profile of the last 24 hours, each hour, with approximate median and unique count, merged from panes of an hour."""
    folder = run_folder(spark, "panes")
    run_to_end(aggregates.save_updates(panes.panes(reading_stream(spark, sf)), folder, run_folder(spark, "checkpoint")))
    return rounded(panes.windows(aggregates.newest(spark.read.parquet(folder), ["w", *panes.SENSOR])))


@query(SQL["stream_profile"])
def stream_pane_moments(spark, sf):
    """What merges exactly of the panes' profile."""
    return stream_profile_panes(spark, sf).drop("median", "unique_count")


# Readings of the stream that are made late: every 13th event comes five hours, every 29th two days after its time.
_ARRIVED = """arrived AS (SELECT event_id, CAST(user_id % 14 AS VARCHAR) AS station_id, value,
    ts - to_hours(CASE WHEN event_id % 29 = 0 THEN 48 WHEN event_id % 13 = 0 THEN 5 ELSE 0 END) AS time FROM events),
  marked AS (SELECT *, max(time) OVER (PARTITION BY station_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL 2 HOUR AS watermark FROM arrived),
  told AS (SELECT *, coalesce(time < watermark, false) AS late FROM marked)"""


@query(f"""WITH {_ARRIVED} SELECT time_bucket(INTERVAL 1 HOUR, time, TIMESTAMP '1970-01-01') AS bucket, station_id, count(*) FILTER (NOT late) AS in_time,
  count(*) FILTER (late) AS late, round(max(epoch_us(watermark) - epoch_us(time)) FILTER (late) / 1000000, 6) AS most_behind FROM told GROUP BY 1, 2""")
def stream_late(spark, sf):
    """Readings in time and late, per station and hour, in three micro-batches."""
    behind = F.when(F.col("event_id") % 29 == 0, 48).when(F.col("event_id") % 13 == 0, 5).otherwise(0)
    arrived = a.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 14).cast("string").alias("station_id"), "value",
        a.ntz(F.col("ts") - F.make_dt_interval(hours=behind)).alias("time"))
    split, checkpoint = late.Split(run_folder(spark, "split")), run_folder(spark, "checkpoint")
    for stream in landed(spark, arrived):
        run_to_end(late.start_split(stream, split, checkpoint, 7200, "event_id"))
    return rounded(late.late_counts(split.in_time(spark), split.late(spark)))


@query("""SELECT DISTINCT date_trunc('minute', ts) AS time, CAST(user_id % 14 AS VARCHAR) AS station_id FROM events""")
def stream_dedupe(spark, sf):
    rows = reading_stream(spark, sf).select(F.date_trunc("minute", "time").alias("time"), "station_id")
    folder = run_folder(spark, "deduped")
    out = aggregates.dedupe(rows).writeStream.format("parquet").option("path", folder).option(
        "checkpointLocation", run_folder(spark, "checkpoint")).trigger(availableNow=True).start()
    run_to_end(out)
    return spark.read.parquet(folder).select("time", "station_id")


@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket, event_type AS variable, count(value) AS n,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2""")
def tumbling_stats(spark, sf):
    e = a.events_long(spark, sf)
    return rounded(e.groupBy(F.window("time", "6 hours").alias("w"), "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).select(
        F.col("w.start").alias("bucket"), "variable", "n", "mean", "std"))


_STUCK = """src AS (SELECT event_id, CAST(user_id % 14 AS VARCHAR) AS station_id, event_type AS variable, ts AS time,
    CASE WHEN event_id % 5 < 3 THEN 0.0 WHEN event_id % 5 = 3 THEN 7.0 ELSE value END AS value FROM events),
  told AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS starts FROM src WHERE value IS NOT NULL
    WINDOW w AS (PARTITION BY station_id, variable ORDER BY time, event_id)),
  isl AS (SELECT *, sum(starts) OVER (PARTITION BY station_id, variable ORDER BY time, event_id) AS island FROM told)"""


@query(f"""WITH {_STUCK} SELECT station_id, variable, CASE WHEN any_value(value) = 0 THEN 'zero' ELSE 'constant' END AS kind, any_value(value) AS value,
    min(time) AS start_time, max(time) AS end_time, count(*) AS run_rows
  FROM isl GROUP BY station_id, variable, island HAVING count(*) >= CASE WHEN any_value(value) = 0 THEN 3 ELSE 2 END""")
def constant_runs(spark, sf):
    """Runs of equal readings over parts of six hours; three readings of five are made 0, one is made 7."""
    turn = F.col("event_id") % 5
    readings = a.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 14).cast("string").alias("station_id"), F.col("event_type").alias("variable"),
        F.col("ts").cast("timestamp_ntz").alias("time"), F.when(turn < 3, 0.0).when(turn == 3, 7.0).otherwise(F.col("value")).alias("value"))
    return runs.constant_runs(readings, min_rows=2, min_zeros=3, order=["time", "event_id"], part_seconds=6 * 3600)


_SENSOR = """src AS (SELECT event_id, CAST(user_id % 14 AS VARCHAR) AS station_id, event_type AS variable, ts AS time,
    CASE WHEN event_id % 5 < 3 THEN 0.0 ELSE value END AS value FROM events),
  runs AS (SELECT *, sum(CASE WHEN value = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, variable ORDER BY time, event_id) AS g,
    lead(time) OVER (PARTITION BY station_id, variable ORDER BY time, event_id) AS following FROM src),
  zeros AS (SELECT station_id, variable, g, count(*) FILTER (value = 0) AS n FROM runs GROUP BY 1, 2, 3),
  longest AS (SELECT station_id, variable, max(n) AS longest_zero_run, arg_max(n, g) AS zero_run FROM zeros GROUP BY 1, 2),
  final AS (SELECT max(time) - INTERVAL 1 HOUR AS watermark FROM src)"""


@query(f"""WITH {_SENSOR} SELECT station_id, variable, count(*) AS readings, max(time) AS last_time, arg_max(value, (time, event_id)) AS last_value,
    any_value(zero_run) AS zero_run, any_value(longest_zero_run) AS longest_zero_run, max(time) + INTERVAL 3 HOUR <= any_value(watermark) AS stale
  FROM runs JOIN longest USING (station_id, variable), final GROUP BY 1, 2""")
def stream_sensor_state(spark, sf):
    """The state of every sensor at the end of a stream in three micro-batches; three readings of five are made 0."""
    readings = a.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 14).cast("string").alias("station_id"), F.col("event_type").alias("variable"),
        F.col("ts").cast("timestamp_ntz").alias("time"), F.when(F.col("event_id") % 5 < 3, 0.0).otherwise(F.col("value")).alias("value"))
    folder, checkpoint = run_folder(spark, "states"), run_folder(spark, "checkpoint")
    for stream in landed(spark, readings):
        run_to_end(sensors.start(stream, folder, checkpoint, stale_seconds=3 * 3600, delay="1 hour", order="event_id"))
    return sensors.current(spark, folder)
