"""Column statistics per station and overall, histograms, rollups and profile payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_binary
from .quantiles import exact_quantiles
from .scale import attach, keep

BINS = 10


def column_profile(long: DataFrame, keys: Sequence[str] = ("station_id", "variable"), bins: int = BINS,
                   digits: int = 4) -> DataFrame:
    """The ten statistics of each group: row, missing and unique counts, mean, median, sample standard
    deviation, min, max, missing percentage and histogram.

    Moments come from one aggregate over the rows. Median, unique count and histogram come from the counts
    per value, so a value that fills a third of a group is one row by then.
    """
    keys = list(keys)
    moments, n_groups = keep(long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")))
    values, _ = keep(long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("copies")))
    unique = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_count"))
    median = exact_quantiles(values, keys, "value", {"median": 0.5}, "copies", moments.select(*keys, "n"))
    hist = histogram(values, moments, keys, bins, n_groups, digits)
    out = moments.join(unique, keys, "left").join(median, keys, "left").join(hist, keys, "left")
    empty = F.array().cast("array<double>"), F.array().cast("array<bigint>")
    return out.select(
        *keys, "row_count",
        *[round_binary(F.col(c), digits).alias(c) for c in ("mean", "median")],
        round_binary(F.when(F.col("n") > 1, F.col("std")), digits).alias("std"),
        *[round_binary(F.col(c), digits).alias(c) for c in ("min", "max")],
        (F.col("row_count") - F.col("n")).alias("missing_count"),
        round_binary((F.col("row_count") - F.col("n")) / F.col("row_count") * 100, 2).alias("missing_percentage"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.coalesce("hist_bins", empty[0]).alias("hist_bins"), F.coalesce("hist_counts", empty[1]).alias("hist_counts"),
    )


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of a value; the last bin is closed, equal limits are widened by a half to each side."""
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    return F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def histogram(values: DataFrame, moments: DataFrame, keys: Sequence[str], bins: int = BINS,
              n_groups: int | None = None, digits: int = 4) -> DataFrame:
    """``hist_bins`` (edges) and ``hist_counts`` of equal bins over each group's range."""
    keys = list(keys)
    limits = moments.select(*keys, "n", F.col("min").alias("_lo"), F.col("max").alias("_hi"))
    binned = attach(values, limits, keys, "n", ["value"], n_groups)
    counts = binned.groupBy(*keys, "_lo", "_hi", bin_of(F.col("value"), F.col("_lo"), F.col("_hi"), bins).alias("_bin")).agg(
        F.sum("copies").alias("_c"))
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    steps = F.sequence(F.lit(0), F.lit(bins))
    return counts.groupBy(*keys, "_lo", "_hi").agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_by_bin")
    ).select(
        *keys,
        F.transform(steps, lambda i: round_binary(lo + (hi - lo) * i / bins, digits)).alias("hist_bins"),
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                    lambda i: F.coalesce(F.try_element_at(F.col("_by_bin"), i), F.lit(0))).alias("hist_counts"),
    )


def profile(long: DataFrame, bins: int = BINS) -> DataFrame:
    """Station profiles and the overall one, told apart by ``level``."""
    stations = column_profile(long, ("station_id", "variable"), bins).withColumn("level", F.lit("station"))
    overall = column_profile(long, ("variable",), bins).withColumn("level", F.lit("global"))
    return stations.unionByName(overall, allowMissingColumns=True)


def quick_profile(long: DataFrame, keys: Sequence[str] = ("station_id", "variable")) -> DataFrame:
    """The approximate twin: one mergeable aggregate, usable on streams."""
    return long.groupBy(*keys).agg(*quick_stats())


def quick_stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("value").isNull()).alias("missing_count"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.percentile_approx("value", 0.5).alias("median"),
        F.approx_count_distinct("value").alias("unique_count"),
    ]


def rollup(obs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per bucket and station: counts, temperature statistics, means of the other variables."""
    two = lambda c: F.round(c, 2)
    return obs.groupBy(F.window("time", width).alias("w"), "station_id").agg(
        F.count(F.lit(1)).alias("row_count"), two(F.avg("temp_out")).alias("mean_temp"),
        two(F.stddev_samp("temp_out")).alias("std_temp"), F.min("temp_out").alias("min_temp"),
        F.max("temp_out").alias("max_temp"), F.count_if(F.col("temp_out").isNull()).alias("missing_temp"),
        two(F.avg("out_hum")).alias("mean_hum"), two(F.avg("wind_speed")).alias("mean_wind"),
        two(F.avg("bar")).alias("mean_bar"),
    ).withColumn("bucket", F.col("w.start")).drop("w")


def payload(profiles: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles joined to node ids by ``station/column``, and those without a node."""
    keyed = profiles.withColumn("node_key", F.concat_ws("/", "station_id", "variable"))
    stats = F.to_json(F.struct(*[c for c in profiles.columns if c not in ("station_id", "variable", "level")]))
    mapped = keyed.join(mapping, "node_key").select("node_id", "station_id", "variable", stats.alias("statistics"))
    return mapped, keyed.join(mapping, "node_key", "left_anti").select("station_id", "variable", "node_key")
