"""Sensor states on a stream against a plain walk."""

import random
from datetime import datetime, timedelta

import numpy as np

from vanemesh.streaming import sensors

START = datetime(2025, 1, 1)
SCHEMA = "seq long, station_id string, variable string, time timestamp_ntz, value double"


def test_zero_runs():
    rng = random.Random(1)
    for _ in range(300):
        z = [rng.random() < 0.6 for _ in range(rng.randint(1, 12))]
        text = "".join("0" if x else "1" for x in z)
        want = (len(text) - len(text.lstrip("0")), len(text) - len(text.rstrip("0")), max(map(len, text.split("1"))))
        assert sensors.zero_runs(np.array(z)) == want


def walk(batches, stale, delay):
    """State by state, batch by batch; the watermark is the latest time of the batches before less the delay."""
    found, latest = {}, datetime(2000, 1, 1)
    for rows in batches:
        mark = latest - delay
        rows = [r for r in rows if r[3] is not None and r[3] >= mark]
        for seq, station, variable, time, value in sorted((r for r in rows if r[3] is not None and r[1] is not None), key=lambda r: (r[3], r[0])):
            s = found.setdefault((station, variable), [0, None, None, 0, 0])
            s[0] += 1
            latest = max(latest, time)
            if s[1] is not None and time < s[1]:
                continue
            s[1], s[2] = time, value
            s[3] = s[3] + 1 if value == 0 else 0
            s[4] = max(s[4], s[3])
    return {k: (*s, s[1] + stale <= latest - delay) for k, s in found.items()}


def test_stream_equals_a_walk_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        station = "silent" if i < 40 and i % 5 == 0 else rng.choice("ab")
        time = START + timedelta(minutes=10 * i - (600 if i % 37 == 36 else 0))  # some are older than the last of their sensor
        rows.append((i, station, rng.choice("uv"), time, rng.choice([0.0, 0.0, 0.0, 1.5, None])))
    rows += [(300, "a", "u", None, 0.0), (301, None, "u", START, 0.0), (302, "once", "u", START + timedelta(minutes=2990), None)]
    batches = [rows[:110], rows[110:120], rows[120:]]
    folder, states = str(tmp_path / "in"), str(tmp_path / "states")
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        sensors.start(stream, states, str(tmp_path / "cp"), 12 * 3600, "1 hour", "seq").awaitTermination()
    got = {(r.station_id, r.variable): tuple(r)[2:] for r in sensors.current(spark, states).collect()}
    want = walk(batches, timedelta(hours=12), timedelta(hours=1))
    assert got == want
    assert {k[0] for k, v in got.items() if v[-1]} == {"silent"} and max(v[4] for v in got.values()) >= 4
