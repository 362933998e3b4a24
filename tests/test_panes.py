import numpy as np
import pytest
from pyspark.sql import functions as F

from vanemesh.streaming import aggregates, panes

T0 = 1_735_689_600


@pytest.fixture
def landed(spark, tmp_path):
    for part in range(3):
        spark.range(400).select(
            F.when(F.col("id") % 4 == 0, "A").otherwise("B").alias("station_id"), F.lit("v").alias("variable"),
            F.timestamp_seconds(F.lit(T0) + (F.col("id") + 400 * part) * 97).alias("time"),
            F.when(F.col("id") % 11 > 0, ((F.col("id") * 7 + part) % 53).cast("double")).alias("value")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def test_windows_of_streamed_panes(spark, tmp_path, landed):
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    aggregates.save_updates(panes.panes(stream, delay="30 days"), out, str(tmp_path / "cp")).awaitTermination()
    saved = aggregates.newest(spark.read.parquet(out), ["w", *panes.SENSOR])
    got = {(r.bucket, r.station_id): r for r in panes.windows(saved, 6).collect()}
    rows = landed.withColumn("w", F.window("time", "6 hours", "1 hour")).select(F.col("w.start").alias("bucket"), "station_id", "value").collect()
    want = {}
    for r in rows:
        want.setdefault((r.bucket, r.station_id), []).append(r.value)
    assert set(got) == set(want) and len(want) > 20
    for key, values in want.items():
        r, known = got[key], np.array([v for v in values if v is not None])
        assert (r.row_count, r.missing_count) == (len(values), len(values) - len(known))
        assert np.isclose(r.mean, known.mean()) and (r["min"], r["max"]) == (known.min(), known.max())
        assert r.std is None if len(known) == 1 else np.isclose(r.std, known.std(ddof=1))
        below, upto = (known < r.median).mean(), (known <= r.median).mean()
        assert below - 0.03 <= 0.5 <= upto + 0.03
        assert abs(r.unique_count - len(set(known))) <= 1 + 0.05 * len(set(known))


def test_panes_without_values(spark, landed):
    empty = landed.where("station_id = 'A'").withColumn("value", F.lit(None).cast("double"))
    got = panes.windows(panes.panes(empty), 2).collect()
    assert got and all((r.mean, r.std, r.median, r.unique_count) == (None, None, None, 0) and r.missing_count == r.row_count for r in got)
    assert panes.windows(panes.panes(empty.where("false")), 2).count() == 0
