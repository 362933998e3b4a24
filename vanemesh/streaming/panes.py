"""Sliding profiles from panes: a reading is counted once, in the pane of one step that holds it, and windows merge their panes.

Counts and moments merge exactly. Medians come from merged KLL sketches and distinct counts from merged HLL sketches, so both are
approximate; a pane's state is bounded however many readings it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENSOR = ("station_id", "variable")


def panes(stream: DataFrame, step: str = "1 hour", delay: str = "2 hours", keys: Sequence[str] = SENSOR) -> DataFrame:
    """``w, keys`` and the mergeable statistics of ``value`` per pane of one ``step``, of a stream or a table."""
    timed = stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)
    return timed.groupBy(F.window("time", step).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("n"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.kll_sketch_agg_double("value").alias("quantiles"), F.hll_sketch_agg(F.col("value").cast("string")).alias("distinct"))


def windows(saved: DataFrame, steps: int = 24, keys: Sequence[str] = SENSOR) -> DataFrame:
    """The profile ``bucket, keys, row_count, missing_count, mean, std, min, max, median, unique_count`` of every window of ``steps``
    panes that holds a reading, from the newest state of the panes (one row each).

    Panes, not readings, are copied to the windows that hold them. A window without a value has NULL statistics and no distinct value.
    """
    keys = list(keys)
    length = F.col("w.end") - F.col("w.start")
    placed = saved.withColumn("bucket", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.col("w.start") - length * k)))
    filled = F.col("n") > 0
    merged = placed.groupBy("bucket", *keys).agg(
        F.sum("row_count").alias("row_count"), F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("mean"), F.sum("m2").alias("_m2"),
        F.collect_list(F.when(filled, F.struct("n", "mean"))).alias("_means"),  # at most one of each pane
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(filled, F.col("quantiles"))).alias("_quantiles"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_count"))
    between = F.aggregate("_means", F.lit(0.0), lambda s, p: s + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return merged.select(
        "bucket", *keys, "row_count", (F.col("row_count") - F.col("n")).alias("missing_count"), "mean",
        F.when(F.col("n") > 1, F.sqrt((F.col("_m2") + between) / (F.col("n") - 1))).alias("std"), "min", "max",
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_quantiles", F.lit(0.5))).alias("median"), "unique_count")
