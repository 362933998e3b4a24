"""Late readings told on a stream against a plain walk in the order of arrival."""

import random
from datetime import datetime, timedelta

import pytest

from vanemesh.streaming import late

START = datetime(2025, 1, 1)
SCHEMA = "seq long, station_id string, time timestamp_ntz, value double"
DELAY = 3600


def arrivals(n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        behind = rng.choice([0, 0, 0, 0, 30, 90, 400])
        rows.append((i, rng.choice("aaaab"), START + timedelta(minutes=5 * i - behind), float(i)))
    return rows + [(n, None, START, 1.0), (n + 1, "a", None, 2.0), (n + 2, "new", START, 3.0)]


def walk(rows):
    latest, found = {}, {}
    for seq, station, time, _ in rows:
        mark = latest[station] - timedelta(seconds=DELAY) if station in latest else None
        found[seq] = (mark, station is None or time is None or (mark is not None and time < mark))
        if time is not None:
            latest[station] = max(latest.get(station, time), time)
    return found


@pytest.mark.parametrize("part_rows", [1, 17, 10_000])
def test_judged_like_a_walk(spark, part_rows):
    rows = arrivals()
    got = late.judged(spark.createDataFrame(rows, SCHEMA).repartition(3), None, DELAY, "seq", part_rows).collect()
    want = walk(rows)
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 30
    for r in got:
        assert r.late == want[r.seq][1]
        assert r.watermark == (want[r.seq][0] if r.station_id and r.time else None)


def test_stream_equals_the_walk_over_batches_and_restarts(spark, tmp_path):
    rows, folder = arrivals(), str(tmp_path / "in")
    split = late.Split(str(tmp_path / "split"))
    for low in range(0, len(rows), 150):
        spark.createDataFrame(rows[low:low + 150], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        late.start_split(stream, split, str(tmp_path / "cp"), DELAY, "seq").awaitTermination()
    want = walk(rows)
    assert {r.seq for r in split.late(spark).collect()} == {s for s, (_, x) in want.items() if x}
    assert {r.seq for r in split.in_time(spark).collect()} == {s for s, (_, x) in want.items() if not x}
    counts = late.late_counts(split.in_time(spark), split.late(spark)).collect()
    assert sum(r.late for r in counts) == sum(x for _, x in want.values()) and sum(r.in_time + r.late for r in counts) == len(rows)
    [untimed] = [r for r in counts if r.bucket is None]
    assert (untimed.station_id, untimed.in_time, untimed.late) == ("a", 0, 1)


def test_a_batch_can_be_repeated(spark, tmp_path, monkeypatch):
    """The sink runs a second time after a failure between its tables and the commit."""
    rows, folder = arrivals(60), str(tmp_path / "in")
    split = late.Split(str(tmp_path / "split"))
    spark.createDataFrame(rows[:40], SCHEMA).coalesce(1).write.parquet(folder)
    start = lambda: late.start_split(spark.readStream.schema(SCHEMA).parquet(folder), split, str(tmp_path / "cp"), DELAY, "seq")
    start().awaitTermination()
    spark.createDataFrame(rows[40:], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    calls = []

    def failing(df, name, settle=late.settle):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return settle(df, name)

    monkeypatch.setattr(late, "settle", failing)
    with pytest.raises(Exception):
        start().awaitTermination()
    start().awaitTermination()
    want = walk(rows)
    assert sorted(r.seq for r in split.late(spark).collect()) == sorted(s for s, (_, x) in want.items() if x)
    assert split.in_time(spark).count() + split.late(spark).count() == len(rows)


def test_empty_batches(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert late.judged(empty, None, DELAY, "seq").count() == 0
    assert late.late_counts(*[late.judged(empty, None, DELAY, "seq")] * 2).count() == 0
