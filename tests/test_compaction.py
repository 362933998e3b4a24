"""Compaction of the store: nothing lost or doubled, few folders, crashes in between."""

import json
from datetime import datetime

import pytest

from vanemesh.streaming import compaction
from vanemesh.streaming import ingest as stream_store

T0 = 1_735_689_600
ORDER = ["landed_at", "source", "feature_no"]


def save(spark, store, k, run="r", rows=None):
    """Batch ``k``: a new reading of each of two stations on one of three days, and one that is stored already."""
    features = rows or [(T0 + 86_400 * (k % 3) + 600 * k, s, float(k)) for s in "ab"] + [(T0, "a", -1.0)] * (k > 0)
    text = json.dumps({"features": [
        {"properties": {"ts": ts, "station_file": s, "temp_out": v}, "geometry": {"coordinates": [20.0, 38.0, 1.0]}} for ts, s, v in features]})
    batch = spark.createDataFrame([(text, datetime(2025, 1, 1, 0, k % 60), str(k))], "value string, landed_at timestamp, source string")
    stream_store._save_batch(spark, batch, run, k, store, ORDER)


def content(store, spark):
    rows = sorted((r.station_id, r.time, r.temp_out) for r in store.observations(spark).collect())
    stations = sorted((r.station_id, r.first_seen, r.last_seen) for r in store.stations(spark).collect())
    log = sorted((r.timestamp, r.stations_count, r.observations_count) for r in store.log(spark).collect())
    return rows, stations, log


def folders(root):
    return sum(1 for p in root.rglob("*") if p.is_dir())


def test_fifty_batches_end_in_few_folders(spark, tmp_path):
    store = stream_store.Store(str(tmp_path / "store"))
    most = 0
    for k in range(50):
        save(spark, store, k)
        if k % 10 == 9:
            store.compact(spark)
            most = max(most, folders(tmp_path / "store"))
    store.compact(spark)
    rows, stations, log = content(store, spark)
    assert len(rows) == 100 and len({r[:2] for r in rows}) == 100 and len(log) == 50 and len(stations) == 2
    assert stations[0][1:] == (datetime(2025, 1, 1, 0, 0), datetime(2025, 1, 1, 0, 49))
    # Ten loose batches at most, each with three folders and its days; then a few for each of three days.
    assert most < 120 and folders(tmp_path / "store") < 40
    assert len(list((tmp_path / "store" / "manifest").glob("v*.json"))) == 1


def test_a_crash_between_write_and_switch_changes_nothing(spark, tmp_path, monkeypatch):
    store = stream_store.Store(str(tmp_path / "store"))
    for k in range(4):
        save(spark, store, k)
    before = content(store, spark)
    create = compaction.Files.create
    monkeypatch.setattr(compaction.Files, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.compact(spark)
    assert content(store, spark) == before and list((tmp_path / "store" / "compacted").rglob("*.parquet"))
    monkeypatch.setattr(compaction.Files, "create", create)
    store.compact(spark)
    assert content(store, spark) == before
    # A crash after the switch: the covered folders are still there, and a batch is repeated.
    assert list((tmp_path / "store" / "observations").rglob("*.parquet"))
    save(spark, store, 3)
    assert content(store, spark) == before
    save(spark, store, 4)
    save(spark, store, 0, run="s")  # a new checkpoint: its readings are stored already
    after = content(store, spark)
    assert len(after[0]) == len(before[0]) + 2 and len({r[:2] for r in after[0]}) == len(after[0])
    store.compact(spark)
    store.compact(spark)
    assert content(store, spark) == after


def test_a_batch_without_a_log_row_is_not_merged(spark, tmp_path, monkeypatch):
    store = stream_store.Store(str(tmp_path / "store"))
    for k in range(2):
        save(spark, store, k)
    monkeypatch.setattr(stream_store, "snapshot_log", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        save(spark, store, 2)
    monkeypatch.undo()
    store.compact(spark)
    save(spark, store, 2)
    rows, _, log = content(store, spark)
    assert len(rows) == 6 and len(log) == 3
    manifest = compaction.newest(compaction.Files(spark, store.folder), store.folder)
    assert all(last == 1 for upto in manifest.covered.values() for last in upto.values())


def test_nothing_to_compact(spark, tmp_path):
    store = stream_store.Store(str(tmp_path / "store"))
    assert store.compact(spark).version == 0
    save(spark, store, 0)
    assert store.compact(spark).version == 0 and len(content(store, spark)[0]) == 2
