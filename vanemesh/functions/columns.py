"""Time, geo and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM


def micros(time: str | Column) -> Column:
    """Microseconds since the epoch (session time zone UTC)."""
    return F.unix_micros(_col(time).cast("timestamp"))


def seconds(time: str | Column) -> Column:
    """Seconds since the epoch as a double, fractions kept."""
    return micros(time) / F.lit(1e6)


def time_bucket(time: str | Column, width_seconds: float) -> Column:
    """Number of the bucket of the given width that the time falls in."""
    return F.floor(micros(time) / F.lit(int(width_seconds * 1_000_000))).cast("long")


def clean(value: str | Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    v = _col(value).cast("double")
    return F.when(~F.isnan(v), v)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def elevation_adjusted(value, elev_diff, variable: Column, temperature_names=("temp",)) -> Column:
    """Temperature gains 0.65 per 100 m and pressure 1.2 per 10 m of difference; others stay."""
    value, elev_diff = _col(value), _col(elev_diff)
    return (
        F.when(variable.isin(*temperature_names), value + elev_diff / 100 * 0.65)
        .when(variable == "bar", value + elev_diff / 10 * 1.2)
        .otherwise(value)
    )


def fixed_text(value: Column, digits: int) -> Column:
    """The value with a fixed number of decimals, exact ties to the even digit."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def round_binary(value: Column, digits: int) -> Column:
    """Round the binary value, exact ties to the even digit (``round`` works on the decimal text)."""
    return fixed_text(value, digits).cast("double")


def percent_text(ratio: Column) -> Column:
    return F.concat(fixed_text(ratio * 100, 1), F.lit("%"))


def status_of(points: str | Column, events: str | Column, limits=(2, 1, 5, 3)) -> Column:
    """Overall status from the counts of point anomalies and of events.

    ``limits`` holds the counts above which a station is at warning (points, events) and critical
    (points, events).
    """
    p, e = _col(points), _col(events)
    warn_p, warn_e, crit_p, crit_e = limits
    return (
        F.when((p == 0) & (e == 0), "normal")
        .when((p > crit_p) | (e > crit_e), "critical")
        .when((p > warn_p) | (e > warn_e), "warning")
        .otherwise("attention")
    )


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
