"""The state of every sensor on a stream: last value, run of zeros, and whether it has fallen silent.

``transformWithStateInPandas`` keeps one small state a sensor (station and variable). Each micro-batch moves it and emits it anew; an
event-time timer, set ``stale_seconds`` after the last reading, marks a sensor stale when the watermark passes it without a newer one.

A sensor's readings of one micro-batch are sorted in one task; the trigger (files or offsets a micro-batch) bounds them. A reading that
is older than the sensor's last one is counted, and neither moves the last value nor joins a run. Null values end a run of zeros and
can be a last value. Readings without a time, a station or a variable are left out, and so are those behind the stream's watermark when
their micro-batch begins: Spark drops them before the state. ``late`` keeps and counts such readings.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .aggregates import newest, save_updates

KEYS = ["station_id", "variable"]
STATE = "readings long, last_micros long, last_value double, zero_run long, longest_zero_run long"
OUTPUT = f"station_id string, variable string, {STATE}, stale boolean"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def zero_runs(zero: np.ndarray) -> tuple[int, int, int]:
    """How many zeros come first, last, and at most in a row."""
    others = np.flatnonzero(~zero)
    if not len(others):
        return len(zero), len(zero), len(zero)
    inside = int(np.diff(others).max() - 1) if len(others) > 1 else 0
    head, tail = int(others[0]), int(len(zero) - 1 - others[-1])
    return head, tail, max(head, tail, inside)


class SensorState(StatefulProcessor):
    """One sensor's state and its timer."""

    def __init__(self, stale_millis: int):
        self.stale_millis = stale_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sensor", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        readings, last, value, run, longest = self.state.get() if self.state.exists() else (0, None, None, 0, 0)
        new = pd.concat(list(rows)).sort_values(["micros", "arrival"], kind="stable")
        readings += len(new)
        if last is not None:
            new = new[new["micros"] >= last]
        if len(new):
            zero = (new["value"] == 0).to_numpy(bool)
            head, tail, most = zero_runs(zero)
            longest = max(longest, most, run + head)
            run = run + tail if tail == len(zero) else tail
            end = new.iloc[-1]
            last, value = int(end["micros"]), None if pd.isna(end["value"]) else float(end["value"])
        self.state.update((readings, last, value, run, longest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = last // 1000 + self.stale_millis
        stale = due <= timerValues.getCurrentWatermarkInMs()
        if not stale:
            self.handle.registerTimer(due)
        yield self._row(key, stale)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)

    def _row(self, key: Any, stale: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, *self.state.get(), stale)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def states(readings: DataFrame, stale_seconds: float, delay: str, order: str) -> DataFrame:
    """The changed states of each micro-batch of ``readings`` (KEYS, time, value, ``order``: whole numbers that tell readings of one
    time apart)."""
    timed = readings.where(F.col("time").isNotNull() & F.col("station_id").isNotNull() & F.col("variable").isNotNull()).select(
        *KEYS, F.col("time").cast("timestamp").alias("time"), "value", F.col(order).cast("long").alias("arrival")).withWatermark("time", delay)
    rows = timed.withColumn("micros", F.unix_micros("time"))
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=SensorState(int(stale_seconds * 1000)), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def start(readings: DataFrame, folder: str, checkpoint: str, stale_seconds: float, delay: str, order: str,
          every: str | None = None) -> StreamingQuery:
    """Keep the states of ``readings``; the changes of each micro-batch are saved in ``folder``."""
    spark = readings.sparkSession
    before = spark.conf.get(PROVIDER_SETTING)
    spark.conf.set(PROVIDER_SETTING, PROVIDER)  # a query keeps the setting that it was started with
    try:
        return save_updates(states(readings, stale_seconds, delay, order), folder, checkpoint, every)
    finally:
        spark.conf.set(PROVIDER_SETTING, before)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every sensor: KEYS, readings, last_time, last_value, zero_run, longest_zero_run, stale."""
    rows = newest(spark.read.parquet(folder), KEYS)
    return rows.withColumn("last_time", F.timestamp_micros("last_micros").cast("timestamp_ntz")).select(
        *KEYS, "readings", "last_time", "last_value", "zero_run", "longest_zero_run", "stale")
