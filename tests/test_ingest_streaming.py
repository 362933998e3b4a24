import json
from datetime import datetime

from pyspark.sql import functions as F

from vanemesh.operators import health, ingest
from vanemesh.sources import geojson
from vanemesh.streaming import aggregates
from vanemesh.streaming import ingest as stream_store

T0 = 1_735_689_600  # 2025-01-01 00:00:00 UTC


def feature(ts=T0, coords=(20.0, 38.0, 100.0), **properties):
    return {"properties": {"ts": ts, **properties}, "geometry": {"coordinates": list(coords)}}


def document(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def test_parse_rules(spark):
    text = document(
        feature(station_file="a", temp_out=1.5), feature(temp_out=2.0), feature(station_file="", fid=""),
        feature(ts=0, station_file="b"), feature(station_file="c", coords=(21.0, 39.0)), feature(fid="f1"))
    rows = geojson.features(spark.createDataFrame([(text,)], "value string"))
    obs = {r.station_id: r for r in geojson.observations(rows).collect()}
    assert set(obs) == {"a", "c", "f1"} and obs["a"].temp_out == 1.5
    assert obs["a"].time.timestamp() == T0 or obs["a"].time == datetime(2025, 1, 1)
    seen = {r.station_id: r for r in geojson.stations(rows).collect()}
    assert set(seen) == {"a", "b", "c", "f1"}
    assert (seen["a"].latitude, seen["a"].longitude, seen["a"].elevation, seen["c"].elevation) == (38.0, 20.0, 100.0, None)


def test_unreadable_snapshot(spark):
    df = spark.createDataFrame([("{broken",), (document(feature(station_file="a")),)], "value string")
    assert geojson.features(df).count() == 1
    assert df.where(geojson.unreadable()).count() == 1


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "time timestamp_ntz, station_id string, temp_out double, seq int")


def test_first_write_wins_and_replay_adds_nothing(spark):
    t = datetime(2025, 1, 1)
    rows = rows_of(spark, (t, "a", 2.0, 2), (t, "a", 1.0, 1), (t, "b", 3.0, 3))
    first = ingest.first_writes(rows, ["seq"])
    assert {(r.station_id, r.temp_out) for r in first.collect()} == {("a", 1.0), ("b", 3.0)}
    assert ingest.new_rows(rows, first, ["seq"]).count() == 0
    late = rows_of(spark, (datetime(2020, 1, 1), "a", 9.0, 4), (t, "a", 7.0, 5))
    assert [r.temp_out for r in ingest.new_rows(late, first, ["seq"]).collect()] == [9.0]


def test_station_update_keeps_first_seen(spark):
    schema = ("station_id string, station_name_en string, station_name_gr string, latitude double, longitude double, "
              "elevation double")
    old = spark.createDataFrame([("a", "Old", "G", 1.0, 2.0, 10.0, datetime(2025, 1, 1), datetime(2025, 1, 1)),
                                 ("z", "Z", "Z", 1.0, 2.0, 3.0, datetime(2025, 1, 1), datetime(2025, 1, 1))],
                                schema + ", first_seen timestamp_ntz, last_seen timestamp_ntz")
    seen = spark.createDataFrame([("a", "Mid", "H", 5.0, 6.0, 20.0, datetime(2025, 2, 1), 1),
                                  ("a", "New", "I", 7.0, 8.0, None, datetime(2025, 3, 1), 2),
                                  ("n", "N", "N", 0.0, 0.0, 1.0, datetime(2025, 3, 1), 3)],
                                 schema + ", at timestamp_ntz, seq int")
    got = {r.station_id: r for r in ingest.upsert_stations(old, seen, "at", ["seq"]).collect()}
    assert (got["a"].station_name_en, got["a"].elevation, got["a"].first_seen, got["a"].last_seen) == (
        "New", None, datetime(2025, 1, 1), datetime(2025, 3, 1))
    assert got["z"].last_seen == datetime(2025, 1, 1) and got["n"].first_seen == datetime(2025, 3, 1)
    less = {r.station_id: r for r in ingest.upsert_stations(old, seen, "at", ["seq"], ingest.REDUCED_VALUES).collect()}
    assert (less["a"].station_name_en, less["a"].station_name_gr, less["a"].elevation) == ("New", "G", 10.0)


def land(folder, name, text):
    (folder / name).write_text(text)


def test_stream_equals_batch_over_files_and_replays(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = stream_store.Store(str(tmp_path / "store"))

    def run():
        stream = stream_store.snapshot_stream(spark, str(inbox), 1)
        stream_store.start_ingest(stream, store, str(tmp_path / "cp")).awaitTermination()

    land(inbox, "1.json", document(feature(station_file="a", temp_out=1.0, station_name_en="One"),
                                   feature(station_file="a", temp_out=5.0, station_name_en="Two")))
    run()
    land(inbox, "2.json", document(feature(station_file="a", temp_out=9.0), feature(T0 + 600, station_file="a", temp_out=2.0)))
    run()
    land(inbox, "3.json", "not json")
    run()
    land(inbox, "4.json", document(feature(T0 - 86400 * 400, station_file="late", temp_out=4.0)))
    run()
    obs = {(r.station_id, r.temp_out) for r in store.observations(spark).collect()}
    assert obs == {("a", 1.0), ("a", 2.0), ("late", 4.0)}
    stations = {r.station_id: r for r in store.stations(spark).collect()}
    assert set(stations) == {"a", "late"} and stations["a"].first_seen <= stations["a"].last_seen
    log = store.log(spark).orderBy("batch_id").collect()
    assert [(r.batch_id, r.status, r.stations_count, r.observations_count) for r in log] == [
        (0, "SUCCESS", 2, 1), (1, "SUCCESS", 2, 1), (2, "ERROR", 0, 0), (3, "SUCCESS", 1, 1)]


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    store = stream_store.Store(str(tmp_path / "store"))
    for k, text in enumerate((document(feature(station_file="a", temp_out=1.0)),
                              document(feature(station_file="a", temp_out=7.0), feature(T0 + 600, station_file="a", temp_out=2.0)))):
        inbox = tmp_path / f"in{k}"
        inbox.mkdir()
        land(inbox, "1.json", text)
        stream = stream_store.snapshot_stream(spark, str(inbox), 1)
        stream_store.start_ingest(stream, store, str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted(r.temp_out for r in store.observations(spark).collect()) == [1.0, 2.0]
    assert [r.observations_count for r in store.log(spark).orderBy("timestamp").collect()] == [1, 1]


def test_failures_are_counted_as_such(spark, tmp_path):
    store = stream_store.Store(str(tmp_path / "store"))
    schema = "value string, landed_at timestamp, source string"
    good, bad, empty = document(feature(station_file="a")), "not json", document()
    for k, value in enumerate((good, bad, bad, empty)):
        batch = spark.createDataFrame([(value, datetime(2025, 1, 1, k), str(k))], schema)
        stream_store._save_batch(spark, batch, "r", k, store, ["landed_at", "source", "feature_no"])
    got = health.collector_health(store.log(spark), F.lit("2025-01-01 04:00:00").cast("timestamp")).first()
    assert (got.run_count, got.error_count, got.consecutive_failures, got.last_success) == (3, 2, 2, datetime(2025, 1, 1, 0))


def test_a_batch_can_be_repeated(spark, tmp_path):
    store = stream_store.Store(str(tmp_path / "store"))
    batch = spark.createDataFrame([(document(feature(station_file="a", temp_out=1.0)), datetime(2025, 1, 1), "f")],
                                  "value string, landed_at timestamp, source string")
    order = ["landed_at", "source", "feature_no"]
    for run, batch_id in (("r", 0), ("r", 0), ("r", 1), ("r", 1), ("s", 0)):
        stream_store._save_batch(spark, batch, run, batch_id, store, order)
    assert store.observations(spark).count() == 1 and store.log(spark).count() == 3


def test_streamed_windows_equal_batch(spark, tmp_path):
    for part in range(3):
        spark.range(40).select(
            F.lit("A").alias("station_id"), F.lit("v").alias("variable"),
            F.timestamp_seconds(F.lit(T0) + (F.col("id") + 40 * part) * 300).alias("time"),
            ((F.col("id") * 7 + part) % 13).cast("double").alias("value")).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, fn, keys in (("hourly", aggregates.hourly, ["station_id"]),
                           ("sliding", aggregates.sliding, ["station_id", "variable"]),
                           ("profile", aggregates.profile, ["station_id", "variable"])):
        out = str(tmp_path / name)
        aggregates.save_updates(fn(stream, delay="30 days"), out, str(tmp_path / f"{name}-cp")).awaitTermination()
        got = aggregates.newest(spark.read.parquet(out), ["w", *keys])
        want = fn(batch, delay="30 days")
        tidy = lambda df: sorted(
            tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))) for r in df.collect())
        assert tidy(got) == tidy(want) and got.count() >= 10


def test_ingested_events_land_in_many_files_and_three_batches(spark, tmp_path, monkeypatch):
    from vanemesh.plans import queries_ingest

    monkeypatch.setattr(queries_ingest, "run_folder", lambda spark, name: f"{tmp_path}/{name}")
    at = datetime(2025, 1, 1)
    rows = [(i, i % 5, at, "click", float(i), "{}") for i in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").repartition(
        6).write.parquet(f"{tmp_path}/events.parquet")
    log = queries_ingest.ingested(spark, str(tmp_path)).log(spark)
    assert len(list((tmp_path / "landed").glob("*.parquet"))) > 3
    got = log.groupBy("batch_id").count().collect()
    assert sorted((r.batch_id, r["count"]) for r in got) == [(0, 30), (1, 30), (2, 30)]
