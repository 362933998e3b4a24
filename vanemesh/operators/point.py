"""Point detectors over long observations ``(station_id, variable, time, value)``.

Every detector returns the flagged rows as ``station_id, variable, time, value, method, expected,
deviation, score, lower, upper``. Note that with a population standard deviation the largest |z| in a
series of n rows is sqrt(n - 1), so the 3-sigma rule cannot flag anything for n <= 10.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SENTINELS, VARIABLES, VariableConfig, per_variable
from .quantiles import exact_quantiles, value_cuts
from .scale import apply_grouped, attach, carry_parts, ddl_of, keep, settle, time_parts, with_halo, with_index

SERIES = ("station_id", "variable")
FLAG_COLUMNS = (
    "station_id", "variable", "time", "value", "method", "expected", "deviation", "score", "lower", "upper",
)


def flags(df: DataFrame, method: str, expected: Column, score: Column, lower: Column, upper: Column) -> DataFrame:
    return df.select(
        "station_id", "variable", "time", "value", F.lit(method).alias("method"),
        expected.cast("double").alias("expected"), (F.col("value") - expected).cast("double").alias("deviation"),
        score.cast("double").alias("score"), lower.cast("double").alias("lower"),
        upper.cast("double").alias("upper"),
    )


def series_stats(long: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )


def _usable(on_null: str) -> Column:
    """``skip`` ignores NULL values; ``propagate`` lets one NULL silence its series."""
    if on_null == "propagate":
        return (F.col("rows") >= 3) & (F.col("n") == F.col("rows"))
    return F.col("n") >= 3


def three_sigma(long: DataFrame, threshold: float | Column = 3.0, on_null: str = "skip",
                keys: Sequence[str] = SERIES) -> DataFrame:
    """Values outside mean ± k · population standard deviation of their series."""
    k = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    stats, rows = keep(series_stats(long, keys))
    stats = stats.where(_usable(on_null) & (F.col("std") > 0))
    joined = attach(long, stats, keys, "rows", ["time"], rows)
    low, high = F.col("mean") - k * F.col("std"), F.col("mean") + k * F.col("std")
    hit = joined.where((F.col("value") > high) | (F.col("value") < low))
    score = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    return flags(hit, "3sigma", F.col("mean"), score, low, high)


def _value_counts(long: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """``copies`` of each value per series (NULL too), ``rows`` and ``n`` per series, and the number of series: one scan."""
    values = settle(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("copies")), "values")
    known = F.when(F.col("value").isNotNull(), F.col("copies")).otherwise(0)
    counts, rows = keep(values.groupBy(*keys).agg(F.sum("copies").alias("rows"), F.sum(known).alias("n")))
    return values, counts, rows


def _median_and_mad(long: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows, n, median, mad`` per series; both medians are taken over value counts."""
    values, counts, rows = _value_counts(long, keys)
    median, _ = keep(exact_quantiles(values, keys, "value", {"median": 0.5}, "copies", counts))
    away = attach(values, median.join(counts, [*keys]), keys, "rows", ["value"], rows).select(
        *keys, F.abs(F.col("value") - F.col("median")).alias("away"), "copies"
    )
    mad = exact_quantiles(away, keys, "away", {"mad": 0.5}, "copies", counts)
    return counts.join(median, [*keys]).join(mad, [*keys]), rows


def _mad_rule(long, threshold, scale, method, on_null, keys):
    stats, rows = _median_and_mad(long, keys)
    stats = stats.where(_usable(on_null) & (F.col("mad") > 0))
    joined = attach(long, stats, keys, "rows", ["time"], rows)
    score = F.lit(scale) * F.abs(F.col("value") - F.col("median")) / F.col("mad")
    width = F.col("mad") * F.lit(threshold / scale)
    return flags(joined.where(score > threshold), method, F.col("median"), score,
                 F.col("median") - width, F.col("median") + width)


def modified_zscore(long: DataFrame, threshold: float = 3.0, on_null: str = "skip",
                    keys: Sequence[str] = SERIES) -> DataFrame:
    """0.6745 · |v - median| / MAD above the threshold."""
    return _mad_rule(long, threshold, 0.6745, "zscore", on_null, keys)


def raw_mad(long: DataFrame, threshold: float = 3.5, on_null: str = "skip",
            keys: Sequence[str] = SERIES) -> DataFrame:
    """|v - median| / MAD above the threshold."""
    return _mad_rule(long, threshold, 1.0, "mad", on_null, keys)


def iqr(long: DataFrame, factor: float = 1.5, keys: Sequence[str] = SERIES) -> DataFrame:
    """Values outside the quartiles widened by ``factor`` interquartile ranges."""
    values, counts, rows = _value_counts(long, keys)
    quart = exact_quantiles(values, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "copies", counts)
    stats = quart.join(counts, [*keys]).where(F.col("n") >= 3)
    joined = attach(long, stats, keys, "n", ["time"], rows)
    spread = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - factor * spread, F.col("q3") + factor * spread
    hit = joined.where((F.col("value") < low) | (F.col("value") > high))
    score = F.when(spread > 0, F.abs(F.col("value") - F.col("median")) / spread)
    return flags(hit, "iqr", F.col("median"), score, low, high)


def sudden_change(long: DataFrame, limit: Column | None = None, part_seconds: float | None = None,
                  keys: Sequence[str] = SERIES) -> DataFrame:
    """Steps from one non-NULL reading to the next that exceed the variable's limit."""
    limit = per_variable("sudden_change") if limit is None else limit
    rows = long.where(F.col("value").isNotNull())
    rows = rows.withColumn("_part", time_parts(rows, keys, part_seconds))
    rows = carry_parts(
        rows, keys, "_part", [F.max_by("value", "time").alias("_last")],
        {"_carried": lambda w: F.lag("_last").over(w)},
    )
    before = F.lag("value").over(Window.partitionBy(*keys, "_part").orderBy("time"))
    rows = rows.withColumn("_before", F.coalesce(before, "_carried")).withColumn("_limit", limit)
    step = F.abs(F.col("value") - F.col("_before"))
    return flags(rows.where(step > F.col("_limit")), "sudden_change", F.col("_before"), step,
                 F.col("_before") - F.col("_limit"), F.col("_before") + F.col("_limit"))


def physical_range(long: DataFrame, configs: Sequence[VariableConfig] = VARIABLES,
                   sentinels: Sequence[float] = SENTINELS) -> DataFrame:
    """Values outside the variable's plausible range, or readings that broken sensors emit."""
    low, high = per_variable("low", configs), per_variable("high", configs)
    hit = long.where(
        F.col("value").isin([float(s) for s in sentinels]) | (F.col("value") < low) | (F.col("value") > high)
    )
    middle = (low + high) / 2
    beyond = F.greatest(low - F.col("value"), F.col("value") - high, F.lit(0.0))
    return flags(hit, "range", middle, beyond, low, high)


def seasonal_residual(long: DataFrame, period: int = 13, threshold: float = 3.0,
                      part_seconds: float | None = None, part_rows: int = 50_000,
                      keys: Sequence[str] = SERIES) -> DataFrame:
    """Residual after a centred moving average and the mean of each phase, beyond k · sigma.

    Needs two full periods; the first and last half period have no centred average and no residual.
    """
    keys = list(keys)
    half = period // 2
    rows = long.where(F.col("value").isNotNull())
    rows = with_index(rows, keys, ["time"], time_parts(rows, keys, part_seconds))
    parts = with_halo(rows, "idx", part_rows, half, half)
    around = Window.partitionBy(*keys, "part").orderBy("idx").rowsBetween(-half, half)
    parts = parts.withColumn("_trend", F.when(F.count("value").over(around) == 2 * half + 1,
                                             F.avg("value").over(around)))
    detrended = parts.where(F.col("home") & F.col("_trend").isNotNull()).withColumn(
        "_phase", F.col("idx") % period
    ).withColumn("_rest", F.col("value") - F.col("_trend")).drop("part", "home")
    detrended = settle(detrended, "detrended")
    phases, n_phases = keep(detrended.groupBy(*keys, "_phase").agg(
        F.avg("_rest").alias("_season"), F.count(F.lit(1)).alias("_in_phase")))
    resid = attach(detrended, phases, [*keys, "_phase"], "_in_phase", ["time"], n_phases).withColumn(
        "_resid", F.col("_rest") - F.col("_season")).drop("_in_phase")
    stats, n_series = keep(resid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.stddev_pop("_resid").alias("_sd")))
    usable = stats.where((F.col("rows") >= 2 * period) & (F.col("_sd") > 0))
    joined = attach(resid, usable, keys, "rows", ["time"], n_series)
    expected, width = F.col("_trend") + F.col("_season"), threshold * F.col("_sd")
    return flags(joined.where(F.abs("_resid") > width), "seasonal_residual", expected,
                 F.abs("_resid") / F.col("_sd"), expected - width, expected + width)


def lof(long: DataFrame, k: int = 20, contamination: float = 0.1, part_rows: int = 50_000,
        keys: Sequence[str] = SERIES) -> DataFrame:
    """Local outlier factor of the values of a series.

    In one dimension the k nearest values lie within k places of the sorted order, and equal values share
    one factor. So the factor is computed per distinct value: at most k + 1 copies of a value can matter,
    neighbours come from a window of ±k places, and the parts of the order overlap by 3k places.
    Equal distances go to the lower value. Series of k or fewer rows are left out.
    """
    keys = list(keys)
    values = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("copies"))
    counts, n_series = keep(values.groupBy(*keys).agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("n")))
    values = attach(values, counts.where(F.col("rows") > k), keys, "n", ["value"], n_series)
    values = value_cuts(values, keys, "value", counts, part_rows)
    copies = values.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k + 1)))))
    ranked = with_index(copies, keys, ["value", "_copy"], F.col("_cut").cast("long"))
    parts = with_halo(ranked, "idx", part_rows, 3 * k, 3 * k).select(
        *keys, "part", "idx", "value", "copies", (F.col("home") & (F.col("_copy") == 1)).alias("home"))
    out = ddl_of(parts, [*keys, "value", "copies"]) + ", _score double"

    def factors(c):
        home = c["home"]
        score = -outlier_factors(c["value"], k)
        return {"value": c["value"][home], "copies": c["copies"][home], "_score": score[home]}

    scored = apply_grouped(parts, [*keys, "part"], ["idx", "value", "copies", "home"], factors, out, "idx")
    return _lowest_share(long, settle(scored, "lof"), contamination, "lof", keys)


def outlier_factors(x: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factor of sorted values; the k nearest lie within k places."""
    n = len(x)
    at = np.arange(n)[:, None] + np.delete(np.arange(-k, k + 1), k)[None, :]
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    away = np.where(inside, np.abs(x[at] - x[:, None]), np.inf)
    nearest = np.argsort(away, axis=1, kind="stable")[:, :k]
    away, at = np.take_along_axis(away, nearest, 1), np.take_along_axis(at, nearest, 1)
    used = np.isfinite(away)
    reach = np.where(used, away, -np.inf).max(axis=1)
    mean_reach = np.where(used, np.maximum(away, reach[at]), 0.0).sum(axis=1) / used.sum(axis=1)
    density = 1.0 / (mean_reach + 1e-10)
    return np.where(used, density[at], 0.0).sum(axis=1) / used.sum(axis=1) / density


def _lowest_share(long, scored, share, method, keys, small_rows: int = 200_000):
    """Flag rows whose value scores strictly below the ``share`` quantile of its series.

    ``scored`` has ``value, copies, _score`` per distinct value; the quantile counts every copy.
    """
    counts, n_series = keep(scored.groupBy(*keys).agg(F.sum("copies").alias("n")))
    offset = exact_quantiles(scored, keys, "_score", {"_offset": share}, frequency="copies", counts=counts)
    low = attach(scored, offset.join(counts, [*keys]), keys, "n", ["value"], n_series).where(
        F.col("_score") < F.col("_offset"))
    low, n_low = keep(low.select(*keys, "value", "copies", "_score", "_offset"))
    hit = attach(long, low, [*keys, "value"], "copies", ["time"], n_low, small_rows)
    none = F.lit(None).cast("double")
    return flags(hit, method, none, -F.col("_score"), none, -F.col("_offset"))


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "3sigma": lambda df: three_sigma(df, per_variable_threshold()),
    "zscore": modified_zscore,
    "mad": raw_mad,
    "iqr": iqr,
    "sudden_change": sudden_change,
    "range": physical_range,
    "seasonal_residual": seasonal_residual,
    "lof": lof,
}


def per_variable_threshold(configs: Sequence[VariableConfig] = VARIABLES) -> Column:
    return F.coalesce(per_variable("threshold", configs), F.lit(3.0))


def register(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    """Add a detector: long observations in, the flag columns out."""
    METHODS[name] = detector


def detect(long: DataFrame, method: str = "3sigma") -> DataFrame:
    """Run one method; an unknown name means 3-sigma."""
    return METHODS.get(method, METHODS["3sigma"])(long)


def detect_configured(long: DataFrame, configs: Sequence[VariableConfig] = VARIABLES) -> DataFrame:
    """Each variable with its own method and threshold."""
    by_method: dict[str, list[VariableConfig]] = {}
    for c in configs:
        by_method.setdefault(c.method if c.method in METHODS else "3sigma", []).append(c)
    parts = []
    for method, group in by_method.items():
        rows = long.where(F.col("variable").isin([c.name for c in group]))
        if method in ("3sigma",):
            parts.append(three_sigma(rows, per_variable_threshold(group)))
        elif method in ("zscore", "mad"):
            rule = modified_zscore if method == "zscore" else raw_mad
            parts += [rule(rows.where(F.col("variable") == c.name), c.threshold) for c in group]
        else:
            parts.append(METHODS[method](rows))
    return reduce(DataFrame.unionByName, parts)


def compare_methods(long: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Flagged rows, series and stations per method."""
    found = reduce(DataFrame.unionByName, [detect(long, m) for m in methods])
    return found.groupBy("method").agg(
        F.count(F.lit(1)).alias("flag_count"),
        F.count_distinct("station_id").alias("station_count"),
        F.count_distinct("station_id", "variable").alias("series_count"),
    )


def first_records(found: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` flags per series by time, with the number left out."""
    over = Window.partitionBy(*SERIES).orderBy("time")
    totals = found.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("total"))
    first = found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)
    return first.join(totals, [*SERIES]).withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))
