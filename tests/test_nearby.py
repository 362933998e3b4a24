"""Edges of ``spatial.neighbors`` and the same edges as a plain table give the same results; the former without a row for each edge."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanemesh.functions import nearby as kernel
from vanemesh.operators import gaps, nearby, spatial, trend

START = datetime(2025, 1, 1)
GEO = "station_id string, latitude double, longitude double, elevation double"
RADIUS = timedelta(hours=6)


def network(spark, n=24, twice=(), seed=3, repeated=False):
    rng = np.random.default_rng(seed)
    places = [(f"s{i}", float(rng.uniform(38, 41)), float(rng.uniform(20, 22)), None if i % 11 == 5 else float(rng.uniform(0, 900))) for i in range(n)]
    places += [places[i] for i in twice] + [("nowhere", None, 21.0, 0.0), ("lonely", -50.0, 0.0, 0.0)]
    rows = []
    for name in [p[0] for p in places[:n]] + ["nowhere", "lonely"]:
        for v in ("temp_out", "bar"):
            for t in range(30):
                if rng.random() < 0.8:
                    value = None if rng.random() < 0.15 else 7.0 if name == "s1" else float(np.sin(t / 3) + rng.normal() * 0.5)
                    rows.append((name, v, START + t * timedelta(hours=1), value))
                    if repeated and rng.random() < 0.1:
                        rows.append((name, v, START + t * timedelta(hours=1), value))
    long = spark.createDataFrame(rows, "station_id string, variable string, time timestamp_ntz, value double").repartition(4)
    asked = long.dropDuplicates(["station_id", "variable", "time"]).where(F.hour("time").isin(3, 11) & F.col("value").isNotNull()).persist()
    stations = spark.createDataFrame(places, GEO)
    noted = spatial.neighbors(stations)
    plain = spark.createDataFrame(noted.collect(), noted.schema)
    return stations, long, asked, noted, plain


def rows(df):
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    """Many small blocks. Python workers keep their own limits."""
    monkeypatch.setattr(nearby.around_each, "__defaults__", (60,))


CASES = [dict(twice=(0, 3, 3)), dict(twice=(1,), repeated=True)]


@pytest.mark.parametrize("case, alignment", [(CASES[0], "complete"), (CASES[1], "pairwise")])
def test_verdicts_as_with_a_table_of_edges(spark, small, case, alignment):
    stations, long, asked, noted, plain = network(spark, **case)
    ghost = spark.createDataFrame([("ghost", "bar", START, 1.0), ("s2", "bar", None, 1.0), ("s2", "rain", START, 1.0)], asked.schema)
    asked = asked.unionByName(ghost)
    got, want = (trend.verify(asked, long, e, stations, RADIUS, alignment) for e in (noted, plain))
    assert got.dtypes == want.dtypes and rows(got) == rows(want)
    assert {r.status for r in got.collect()} >= {"success", "station_not_found", "no_neighbors", "no_data"}
    few = trend.verify(asked, long, noted, stations, RADIUS, alignment, named=("warning",)).collect()
    assert all(bool(r.neighbor_ids) == (r.type == "warning") for r in few)


@pytest.mark.parametrize("case", CASES[1:])
def test_pairs_tables_and_distances_as_with_a_table_of_edges(spark, small, case):
    _, long, asked, noted, plain = network(spark, **case)
    for make in (
        lambda e: trend.pair_correlations(trend.anomaly_windows(asked, long, e, RADIUS)),
        lambda e: trend.comparison_table(asked, long, e, RADIUS, 3),
        lambda e: trend.distance_evidence(asked.withColumn("status", F.lit("insufficient_points")), long.dropDuplicates(["station_id", "variable", "time"]), e, RADIUS),
        lambda e: trend.station_pair_correlations(long, e),
    ):
        got, want = make(noted), make(plain)
        assert rows(got) == rows(want) and got.dtypes == want.dtypes and not want.isEmpty()


def test_no_row_is_written_for_an_anomaly_and_a_neighbour(spark, monkeypatch):
    """What is written and shuffled follows the readings, however many neighbours they have."""
    written = {}

    def counted(df, name, settle=nearby.settle):
        df = settle(df, name)
        written[name] = max(written.get(name, 0), df.count())
        return df

    for module in (trend, nearby):
        monkeypatch.setattr(module, "settle", counted)
    stations, long, asked, noted, plain = network(spark, 40)
    found = trend.verify(asked, long, noted, stations, RADIUS).persist()
    assert found.agg(F.sum("n_neighbors")).first()[0] > 4 * asked.count()
    assert max(written.values()) <= asked.count() and "windows" not in written
    shuffled = []

    def watched(rows, *args, run=nearby.run_blocks):
        shuffled.append(rows.count())
        return run(rows, *args)

    monkeypatch.setattr(nearby, "run_blocks", watched)
    trend.pair_correlations(trend.anomaly_windows(asked, long, noted, RADIUS))
    copied = trend.anomaly_windows(asked, long, plain, RADIUS).count()
    assert shuffled[0] < 3 * long.count() < copied / 2


def test_neighbours_of_a_block_are_the_edges(spark):
    rng = np.random.default_rng(1)
    n = 300
    lat = np.concatenate([rng.uniform(-89, 89, 100), rng.normal(50, 1, 100), rng.normal(-17, 1, 100)])
    lon = np.concatenate([rng.uniform(-180, 180, 100), rng.normal(8, 1, 100), (rng.normal(180, 1, 100) + 180) % 360 - 180])
    elev, known = rng.uniform(0, 900, n), rng.random(n) < 0.9
    names = np.arange(n)
    s = spark.createDataFrame([(f"{i:03d}", float(lat[i]), float(lon[i]), float(elev[i]) if known[i] else None) for i in names], GEO)
    for km, high, passes in ((100.0, 500.0, True), (800.0, None, True), (60.0, 300.0, False)):
        places = kernel.Places(names, lat, lon, elev, known, km, high, passes)
        got = {(i, int(j)) for i in range(n) for j in places.edges(i)}
        assert got == {(int(r.src), int(r.dst)) for r in spatial.neighbors(s, km, high, "pass" if passes else "fail").collect()}


def test_snapshots_and_grids_as_with_a_table_of_edges(spark, monkeypatch):
    _, long, asked, noted, plain = network(spark, twice=(0, 3, 3), repeated=True)
    snapshot = asked.unionByName(long.where("station_id = 's4'").limit(3)).drop("time")
    dealt = []

    def watched(rows, *args, run=nearby.run_blocks):
        dealt.append(rows.count())
        return run(rows, *args)

    monkeypatch.setattr(nearby, "run_blocks", watched)
    for make in (
        lambda e: spatial.snapshot_outliers(snapshot, e, 2.0, 3, ("temp_out",)),
        lambda e: spatial.distance_class(snapshot.where("variable = 'bar'"), e),
        lambda e: gaps.grid_counts(gaps.neighborhood_grid(long, e, "10 hours")),
    ):
        got, want = make(noted), make(plain)
        assert got.dtypes == want.dtypes and rows(got) == rows(want) and not want.isEmpty()
    # Before, each of these steps shuffled a row for every edge and value.
    assert len(dealt) == 3 and max(dealt[:2]) < plain.count()
