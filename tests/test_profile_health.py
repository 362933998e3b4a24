from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanemesh.config import TimeRange, ntz
from vanemesh.functions.columns import status_of
from vanemesh.operators import health, profile, report, views
from vanemesh.sources import tables

START = datetime(2025, 1, 1)
S = ("A", "wind_speed")


def one(df):
    return df.first().asDict()


def test_ten_statistics(make_long):
    p = one(profile.column_profile(make_long({S: [1, 2, 2, None, 10]})))
    assert (p["row_count"], p["mean"], p["median"], p["missing_count"], p["missing_percentage"], p["unique_count"]) == (
        5, 3.75, 2.0, 1, 20.0, 3)
    assert (p["min"], p["max"], p["std"]) == (1.0, 10.0, round(np.std([1, 2, 2, 10], ddof=1), 4))
    counts, edges = np.histogram([1, 2, 2, 10], bins=10)
    assert p["hist_counts"] == counts.tolist() and np.allclose(p["hist_bins"], edges)


def test_equal_values_fall_into_the_middle_bin(make_long):
    p = one(profile.column_profile(make_long({S: [5, 5]})))
    assert p["hist_counts"] == [0] * 5 + [2] + [0] * 4
    assert p["hist_bins"][0] == 4.5 and p["hist_bins"][-1] == 5.5


def test_single_and_missing_values(make_long):
    p = one(profile.column_profile(make_long({S: [7]})))
    assert p["std"] is None and p["mean"] == p["median"] == 7.0
    p = one(profile.column_profile(make_long({S: [None, None]})))
    assert p["mean"] is None and p["unique_count"] == 0 and p["hist_counts"] == [] and p["missing_percentage"] == 100.0
    assert profile.column_profile(make_long({S: [1]}).limit(0)).count() == 0


def test_histogram_equals_numpy(make_long):
    x = np.random.default_rng(0).exponential(10, 500)
    p = one(profile.column_profile(make_long({S: x})))
    assert p["hist_counts"] == np.histogram(x, 10)[0].tolist()


def test_levels(make_long):
    got = profile.profile(make_long({S: [1, 2], ("B", "wind_speed"): [3, None]}))
    overall = got.where("level = 'global'").first()
    assert (overall.row_count, overall.mean, overall.missing_count) == (4, 2.0, 1)
    assert got.where("level = 'station'").count() == 2


def test_time_ranges():
    closed = TimeRange.resolve(end="2025-01-01 06:00:00", hours=6)
    assert closed.start == START and closed.hours == 6
    assert TimeRange.resolve(start="2025-01-01", end="now", now=datetime(2025, 1, 2)).hours == 24
    shifted = TimeRange.resolve(start="2025-01-01T00:00:00+02:00", end="2025-01-01")
    assert shifted.start == datetime(2024, 12, 31, 22) and shifted.hours == 2
    with pytest.raises(ValueError):
        TimeRange.resolve(start="2025-01-01")


def test_both_ends_and_half_open(make_long):
    obs = make_long({S: range(10)}).withColumn("wind_speed", F.col("value"))
    end = START + timedelta(minutes=90)
    assert tables.scan(obs, TimeRange(START, end)).count() == 10
    assert tables.scan(obs, TimeRange(START, end, "left")).count() == 9
    assert tables.scan(obs, variables=["wind_speed", "nothing"]).columns == ["station_id", "time", "wind_speed"]


def test_stalled_station(make_long):
    x = [0.0] * 419 + [5.0, 6.0] * 83
    long = make_long({S: x})
    stations = long.select("station_id").distinct().unionByName(long.select(F.lit("Z").alias("station_id")).distinct())
    got = {r.station_id: r for r in health.station_health(long, stations, 7).collect()}
    assert got["A"].data_completeness == pytest.approx(585 / 1008) and got["A"].overall_status == "critical"
    assert got["Z"].overall_status == "no_data" and got["Z"].data_points == 0
    v = health.variable_health(long).first()
    assert v.zero_ratio == pytest.approx(419 / 585)
    assert v.issues == ["High zero ratio (71.6%) - sensor may be stalled"]


def test_limits_are_strict(make_long):
    long = make_long({("A", "v"): [0] * 3 + [5, 9, 1, 7, 3, 8, 2], ("B", "v"): [None] * 5 + [1, 9, 3, 7, 5],
                      ("C", "v"): [None] * 19 + [4], ("D", "v"): [4.0] * 10})
    got = {r.station_id: r for r in health.variable_health(long).collect()}
    assert got["A"].issues == [] and got["B"].issues == []
    assert got["C"].issues == ["High missing rate (95.0%)"]
    assert got["D"].issues == ["Low variance (0.000) - sensor may be stuck"]


def test_percent_ties_go_to_the_even_digit(make_long):
    v = health.variable_health(make_long({S: [0] * 5 + [3, 9, 4, 8, 1, 7, 2, 6, 5, 9, 3]})).first()
    assert v.zero_ratio == 0.3125 and v.issues[0].startswith("High zero ratio (31.2%)")


def test_status_table(spark):
    cases = {(0, 0): "normal", (1, 0): "attention", (3, 0): "warning", (6, 0): "critical", (0, 2): "warning",
             (0, 4): "critical", (5, 3): "warning"}
    df = spark.createDataFrame(list(cases), "p int, e int").withColumn("s", status_of("p", "e"))
    assert {(r.p, r.e): r.s for r in df.collect()} == cases


def test_decline_is_a_fall(spark):
    rows = [("down", START + timedelta(days=d, minutes=10 * i)) for d, n in ((0, 100), (1, 80), (2, 40)) for i in range(n)]
    rows += [("up", START + timedelta(days=d, minutes=10 * i)) for d, n in ((0, 40), (2, 100)) for i in range(n)]
    got = health.declining(spark.createDataFrame(rows, "station_id string, time timestamp_ntz")).collect()
    assert [r.station_id for r in got] == ["down"] and got[0].fall == pytest.approx(60 / 144)


def test_collector_health(spark):
    at = lambda m: START + timedelta(minutes=m)
    log = spark.createDataFrame([(at(0), "SUCCESS", 14), (at(10), "ERROR", 0), (at(20), "SUCCESS", 13), (at(30), "ERROR", 0),
                                 (at(40), "ERROR", 0)], "timestamp timestamp_ntz, status string, observations_count int")
    got = health.collector_health(log, ntz(at(50))).first()
    assert (got.consecutive_failures, got.error_count, got.observation_count, got.age_minutes) == (2, 3, 27, 30.0)


def test_freshness_and_snapshot(make_long):
    obs = make_long({S: range(36)}).unionByName(make_long({("B", "wind_speed"): range(5)}))
    got = {r.station_id: r for r in health.freshness(obs, ntz(START + timedelta(minutes=359))).collect()}
    assert got["A"].is_fresh and got["A"].is_complete and got["A"].age_minutes == 9
    assert not got["B"].is_fresh and got["B"].recent_times == 5
    assert views.snapshot(obs).select("station_id").collect()[0][0] == "A"


def test_rollup_counts_missing(make_long):
    obs = make_long({S: [1, None, 3, 4, 5, 6, 7]}).select("station_id", "time", *[
        F.col("value").alias(c) for c in ("temp_out", "out_hum", "wind_speed", "bar")])
    first, second = profile.rollup(obs).orderBy("bucket").collect()
    assert (first.row_count, first.missing_temp, first.mean_temp, second.row_count, second.std_temp) == (6, 1, 3.8, 1, None)


def test_comprehensive_report(spark, make_long):
    long = make_long({S: [1, 2] * 20})
    stations = spark.createDataFrame([("A",), ("Z",)], "station_id string")
    points = long.limit(7).withColumn("method", F.lit("3sigma"))
    events = spark.createDataFrame([("A", "wind_speed", START, START, 3, 0.3, "medium")],
                                   "station_id string, variable string, start_time timestamp_ntz, end_time timestamp_ntz, "
                                   "length int, duration_hours double, severity string")
    got = {r.station_id: r for r in report.comprehensive(stations, long, points, events).collect()}
    a = got["A"]
    assert (a.overall_status, a.total_points, a.total_events, a.data_count) == ("critical", 7, 1, 40)
    assert a.point_anomalies["wind_speed"]["count"] == 7 and len(a.point_anomalies["wind_speed"]["records"]) == 3
    assert got["Z"].overall_status == "no_data" and got["Z"].total_points == 0


def test_overrides_and_retention(spark):
    stations = spark.createDataFrame([("a", "A", 1.0), ("b", "B", 2.0)], "station_id string, name string, elevation double")
    extra = spark.createDataFrame([("a", True, "New", None), ("b", False, None, None)],
                                  "station_id string, enabled boolean, name string, elevation double")
    assert [tuple(r) for r in tables.station_overrides(stations, extra).collect()] == [("a", "New", 1.0)]
    obs = spark.createDataFrame([(datetime(2023, 12, 31),), (datetime(2024, 1, 1),)], "time timestamp_ntz")
    assert tables.retained(obs, ntz(START)).count() == 1


def test_newest_first_numbers_rows_over_parts(spark):
    start = datetime(2025, 1, 1)
    rows = [(f"s{i % 3}", start + timedelta(hours=7 * (i // 3))) for i in range(60)] + [("s9", None)]
    got = views.newest_first(spark.createDataFrame(rows, "station_id string, time timestamp_ntz")).collect()
    want = sorted(rows[:-1], key=lambda r: (-(r[1] - start).total_seconds(), r[0])) + rows[-1:]
    assert [(r.station_id, r.time) for r in got] == want
    assert [r.position for r in got] == list(range(1, 62))
    assert views.newest_first(spark.createDataFrame([], "station_id string, time timestamp_ntz")).count() == 0
