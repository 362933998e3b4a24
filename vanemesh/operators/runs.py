"""Sensors that stand still: runs of equal readings, those of zeros apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .point import SERIES
from .scale import carry_parts, settle, time_parts


def constant_runs(long: DataFrame, min_rows: int = 6, min_zeros: int = 3, order: Sequence[str] = ("time",),
                  part_seconds: float | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """``keys, kind, value, start_time, end_time, run_rows``: maximal runs of equal non-NULL readings in time order.

    ``kind`` is zero (at least ``min_zeros`` readings of 0) or constant (at least ``min_rows`` of another value). NULL readings neither
    end a run nor count. ``order`` starts with time; readings that tie in all of it stand by value. A series is cut into parts by time.
    Each part is reduced to its runs; a part's first run goes on from the last of the part before if their values are equal, and a
    run may span many parts.
    """
    keys, order = list(keys), list(order)
    rows = long.where(F.col("value").isNotNull())
    rows = rows.withColumn("_part", time_parts(rows, keys, part_seconds))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order, "value")
    rows = rows.withColumn("_new", F.coalesce(F.col("value") != F.lag("value").over(inside), F.lit(False)).cast("int"))
    # The rows were dealt by series and part, so their runs are counted where they are.
    runs = settle(rows.withColumn("_run", F.sum("_new").over(inside)).groupBy(*keys, "_part", "_run").agg(
        F.first("value").alias("value"), F.min("time").alias("start_time"), F.max("time").alias("end_time"),
        F.count(F.lit(1)).alias("run_rows")), "runs")
    runs = carry_parts(runs, keys, "_part", [F.max_by("value", "_run").alias("_last")], {"_before": lambda w: F.lag("_last").over(w)})
    runs = runs.withColumn("_starts", 1 - ((F.col("_run") == 0) & F.coalesce(F.col("value") == F.col("_before"), F.lit(False))).cast("int"))
    runs = carry_parts(runs, keys, "_part", [F.sum("_starts").alias("_n")], {
        "_earlier": lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    here = Window.partitionBy(*keys, "_part").orderBy("_run")
    merged = runs.withColumn("_id", F.sum("_starts").over(here) + F.col("_earlier")).groupBy(*keys, "_id").agg(
        F.first("value").alias("value"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum("run_rows").alias("run_rows"))
    kind = F.when(F.col("value") == 0, "zero").otherwise("constant")
    return merged.where(F.col("run_rows") >= F.when(F.col("value") == 0, min_zeros).otherwise(min_rows)).select(
        *keys, kind.alias("kind"), "value", "start_time", "end_time", "run_rows")
