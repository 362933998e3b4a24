import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanemesh.operators import report, spatial, trend

GEO = "station_id string, latitude double, longitude double, elevation double"
# Places of a real network.
PLACES = [
    ("amfissa", 38.52491, 22.386218, 168.0), ("dodoni", 39.556817, 20.78555, 675.0),
    ("embonas", 36.224385, 27.855402, 430.0), ("grevena", 40.08919, 21.445693, 510.0),
    ("heraclion", 35.300751, 25.163781, 115.0), ("kolympari", 35.52483, 23.79876, 40.0),
    ("makrinitsa", 39.405349, 22.987778, 850.0), ("portaria", 39.38786976, 22.99513725, 600.0),
    ("sparti", 37.053581, 22.437633, 204.0), ("uth_volos", 39.36076, 22.93165, 9.0),
    ("vlasti", 40.4584, 21.519036, 1194.0), ("volos", 39.3744678, 22.9619388, 52.0),
    ("volos-port", 39.357552, 22.950442, 20.0), ("zagora", 39.4482, 23.100689, 505.0),
]


def km(a, b):
    la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def brute(places, radius=100, elev=500):
    return {(a[0], b[0]) for a in places for b in places if a[0] != b[0] and km(a, b) <= radius and not (
        a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > elev)}


def pairs(edges):
    return {(r.src, r.dst) for r in edges.collect()}


def test_neighbors_of_a_real_network(spark):
    s = spark.createDataFrame(PLACES, GEO)
    edges = spatial.neighbors(s)
    assert pairs(edges) == brute(PLACES)
    d = {r.station_id: r.degree for r in spatial.degrees(s, edges).collect()}
    assert d["embonas"] == 0 and d["volos"] == 3
    assert spatial.links(edges).count() * 2 == edges.count()


@pytest.mark.parametrize("radius", [15, 100, 800])
def test_neighbors_anywhere_on_the_globe(spark, radius, monkeypatch):
    """Random places with crowds, the date line and high latitudes; crowded cells are split."""
    monkeypatch.setattr(spatial, "CELL_SHARE", 7)
    rng = np.random.default_rng(radius)
    places = [(f"s{i}", float(a), float(b), float(e)) for i, (a, b, e) in enumerate(zip(
        np.concatenate([rng.uniform(-85, 85, 60), rng.normal(50, 0.3, 60), rng.normal(-17, 1, 40)]),
        np.concatenate([rng.uniform(-180, 180, 60), rng.normal(8, 0.3, 60), (rng.normal(180, 1, 40) + 180) % 360 - 180]),
        rng.uniform(0, 900, 160)))]
    assert pairs(spatial.neighbors(spark.createDataFrame(places, GEO), radius)) == brute(places, radius)


def test_a_station_near_a_pole_keeps_the_cells_of_the_others(spark):
    rng = np.random.default_rng(9)
    places = [(f"s{i}", float(a), float(b), 0.0) for i, (a, b) in enumerate(zip(rng.uniform(-60, 60, 150), rng.uniform(-180, 180, 150)))]
    polar = [("pole", 89.9, 10.0, 0.0), ("across", 89.7, -170.0, 0.0), ("exact", 90.0, 0.0, 0.0), ("south", -89.95, 99.0, 0.0)]
    cells = lambda rows: {r.station_id: r["count"] for r in spatial.cells_around(
        spark.createDataFrame(rows, GEO), 100).groupBy("station_id").count().collect()}
    alone, together = cells(places), cells(places + polar)
    assert {k: together[k] for k in alone} == alone and max(alone.values()) <= 12
    assert pairs(spatial.neighbors(spark.createDataFrame(places + polar, GEO), 100)) == brute(places + polar)


def test_limits_of_distance_and_elevation(spark):
    per_km = 1 / (math.pi * 6371 / 180)
    places = [("o", 0.0, 0.0, 0.0), ("near", 99.999 * per_km, 0.0, 500.0), ("far", -100.001 * per_km, 0.0, 0.0),
              ("high", 0.0, 0.1, 501.0), ("unknown", 0.0, -0.1, None)]
    s = spark.createDataFrame(places, GEO)
    assert {d for a, d in pairs(spatial.neighbors(s)) if a == "o"} == {"near", "unknown"}
    assert {d for a, d in pairs(spatial.neighbors(s, null_elev="fail")) if a == "o"} == {"near"}


def star(spark, n):
    """Station ``o`` with n neighbours."""
    return spark.createDataFrame([("o", f"n{i}", 10.0, 0.0) for i in range(n)],
                                 "src string, dst string, dist_km double, elev_diff double")


def snapshot(spark, values):
    return spark.createDataFrame([(k, "temp_out", v) for k, v in values.items()],
                                 "station_id string, variable string, value double")


def test_snapshot_outlier_and_fallbacks(spark):
    edges = star(spark, 3)
    got = spatial.snapshot_outliers(snapshot(spark, {"o": 50.0, "n0": 10.0, "n1": 11.0, "n2": 12.0}), edges).first()
    assert got.is_outlier and got.deviation == pytest.approx(39 / 1.4826)
    same = spatial.snapshot_outliers(snapshot(spark, {"o": 10.5, "n0": 10.0, "n1": 10.0, "n2": 10.0}), edges).first()
    assert same.deviation == pytest.approx(0.5 / (1.4826 * 1e-6))
    split = spatial.snapshot_outliers(snapshot(spark, {"o": 11.0, "n0": 10.0, "n1": 10.0, "n2": 13.0}), edges).first()
    assert split.deviation == pytest.approx(1 / (1.4826 * np.std([10, 10, 13])))
    assert spatial.snapshot_outliers(snapshot(spark, {"o": 9.0, "n0": 1.0, "n1": None}), edges).count() == 0


def matrix(spark, table, start, step=timedelta(minutes=30)):
    rows = [(s, "temp_out", start + i * step, v) for s, values in table.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, variable string, time timestamp_ntz, value double")


def complete_edges(spark, names):
    return spark.createDataFrame([(a, b, 10.0, 0.0) for a in names for b in names if a != b],
                                 "src string, dst string, dist_km double, elev_diff double")


def judge(spark, table, target, **options):
    start = datetime(2025, 11, 20, 8)
    long = matrix(spark, table, start)
    n = len(table[target])
    anomaly = long.where((F.col("station_id") == target) & (F.col("time") == start + (n - 1) * timedelta(minutes=30)))
    stations = spark.createDataFrame([(k,) for k in table], "station_id string")
    edges = options.pop("edges", None) or complete_edges(spark, list(table))
    return trend.verify(anomaly, long, edges, stations, timedelta(hours=6), **options).first()


COLD_FRONT = {
    "uth_volos": [15.2, 15.1, 14.8, 14.4, 13.9, 13.2, 12.4, 11.6, 11.0, 10.5, 10.3, 10.2, 10.1],
    "volos": [15.5, 15.4, 15.2, 14.9, 14.4, 13.7, 12.9, 12.1, 11.4, 10.9, 10.6, 10.4, 10.3],
    "zagora": [12.8, 12.7, 12.5, 12.1, 11.6, 10.9, 10.1, 9.4, 8.8, 8.5, 8.3, 8.2, 8.2],
    "larissa": [16.1, 16.0, 15.8, 15.4, 14.9, 14.2, 13.4, 12.7, 12.1, 11.7, 11.5, 11.4, 11.4],
}
FAILURE = {
    "pelion": [5.2, 5.3, 5.4, 5.3, 5.2, 5.1, 5.0, 4.9, 4.8, 4.9, 5.0, 5.1, 99.0],
    "zagora": [8.1, 8.2, 8.3, 8.2, 8.1, 8.0, 7.9, 7.8, 7.7, 7.6, 7.7, 7.8, 7.9],
    "volos": [10.2, 10.3, 10.4, 10.5, 10.6, 10.7, 10.8, 10.9, 11.0, 11.1, 11.2, 11.3, 11.4],
}


def test_cold_front_is_weather(spark):
    got = judge(spark, COLD_FRONT, "uth_volos")
    assert (got.status, got.type, got.label, got.n_neighbors) == ("success", "weather_event", "Weather Event", 3)
    want = np.median([np.corrcoef(COLD_FRONT["uth_volos"], COLD_FRONT[k])[0, 1] for k in COLD_FRONT if k != "uth_volos"])
    assert got.median_corr == pytest.approx(want)


def test_jump_to_99_is_a_failure(spark):
    got = judge(spark, FAILURE, "pelion")
    r = [np.corrcoef(FAILURE["pelion"], FAILURE[k])[0, 1] for k in ("zagora", "volos")]
    assert got.type == "critical_failure" and got.median_corr == pytest.approx(np.median(r))
    assert got.description == f"Trend Inconsistent (Corr: {np.median(r):.2f})"


def test_one_close_neighbour_rescues(spark):
    x = FAILURE["pelion"]
    rng = np.random.default_rng(0)
    table = {"t": x, "a": [v / 2 + 1 for v in x], "b": rng.normal(size=13).tolist(), "c": rng.normal(size=13).tolist()}
    assert judge(spark, table, "t").type == "weather_event"


def test_statuses(spark):
    x = FAILURE["pelion"]
    assert judge(spark, {"t": x, "a": [1.0] * 13}, "t").status == "no_valid_correlations"
    assert judge(spark, {"t": x, "a": [1.0] * 12 + [2.0], "b": [3.0] * 13}, "t").n_neighbors == 1
    assert judge(spark, {"t": x, "a": [None] * 13}, "t").status == "insufficient_points"
    assert judge(spark, {"t": x[-3:], "a": [1.0, 2.0, 3.0]}, "t").status == "insufficient_points"
    none = complete_edges(spark, ["y", "z"])
    assert judge(spark, {"t": x, "y": x, "z": x}, "t", edges=none).status == "no_neighbors"
    got = judge(spark, {"t": x, "a": [None] * 13, "b": FAILURE["volos"]}, "t", alignment="pairwise")
    assert got.status == "success" and got.n_neighbors == 1


def test_unknown_station_and_no_data(spark):
    start = datetime(2025, 1, 1)
    long = matrix(spark, {"a": [1.0, 2.0, 4.0, 3.0, 5.0, 6.0]}, start)
    asked = spark.createDataFrame([("ghost", "temp_out", start, 1.0), ("b", "temp_out", start, 1.0)],
                                  "station_id string, variable string, time timestamp_ntz, value double")
    stations = spark.createDataFrame([("a",), ("b",)], "station_id string")
    got = trend.verify(asked, long, complete_edges(spark, ["a", "b"]), stations, timedelta(hours=6)).collect()
    assert {r.station_id: r.status for r in got} == {"ghost": "station_not_found", "b": "no_data"}


def test_window_is_closed_and_gaps_are_filled(spark):
    table = {"t": [1, 2, 3, 4, 9], "a": [2, None, 3, 5, 8]}
    start = datetime(2025, 1, 1)
    long = matrix(spark, {k: [None if v is None else float(v) for v in x] for k, x in table.items()}, start)
    asked = long.where((F.col("station_id") == "t") & (F.col("time") == start + timedelta(hours=2)))
    windows = trend.anomaly_windows(asked, long, complete_edges(spark, ["t", "a"]), timedelta(hours=2))
    assert windows.count() == 10
    got = trend.pair_correlations(windows).where("member = 'a'").first()
    assert got.points == 5 and got["corr"] == pytest.approx(np.corrcoef(table["t"], [2, 2.5, 3, 5, 8])[0, 1])


def test_quality_counts(spark):
    keys = "station_id string, variable string, time timestamp_ntz"
    t = datetime(2025, 1, 1)
    labels = spark.createDataFrame([("a", "v", t, "weather_event"), ("b", "v", t, "weather_event"),
                                    ("c", "v", t, "critical_failure")], keys + ", expected_type string")
    found = spark.createDataFrame([("a", "v", t, "weather_event"), ("b", "v", t, "warning")], keys + ", type string")
    got = report.detection_quality(labels, found).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall, got.f1) == (1, 1, 1, 0.5, 0.5, 0.5)


def test_distance_evidence_takes_the_last_reading_before(spark):
    at = datetime(2025, 1, 1)
    hours = lambda h: at + timedelta(hours=h)
    rows = [("t", 0, 50.0), ("a", -3, 1.0), ("a", -1, 10.0), ("a", 1, 99.0), ("b", -2, 12.0), ("b", -1, None), ("c", 0, 11.0), ("far", -50, 7.0), ("lone", 0, 5.0)]
    long = spark.createDataFrame([(s, "v", hours(h), v) for s, h, v in rows], "station_id string, variable string, time timestamp_ntz, value double")
    edges = spark.createDataFrame([("t", x) for x in ("a", "b", "c", "far")] + [("lone", "far")], "src string, dst string")
    verdicts = spark.createDataFrame(
        [("t", "v", at, 50.0, "insufficient_points"), ("lone", "v", at, 5.0, "no_valid_correlations"), ("a", "v", hours(-1), 10.0, "success")],
        "station_id string, variable string, time timestamp_ntz, value double, status string")
    got = {r.station_id: r for r in trend.distance_evidence(verdicts, long, edges, timedelta(hours=6)).collect()}
    assert (got["t"].distance_neighbors, got["t"].neighbor_median, got["t"].distance, got["t"].distance_type) == (3, 11.0, 39.0, "critical_failure")
    assert got["lone"].distance_type is None and got["a"].distance is None and len(got) == 3
