"""Variables, thresholds and the time range of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VariableConfig:
    name: str
    label: str
    unit: str
    threshold: float = 3.0
    method: str = "3sigma"
    sudden_change: float | None = None
    low: float | None = None
    high: float | None = None
    variance_floor: float = 0.1


# The detected variables with their labels, units and limits.
VARIABLES = (
    VariableConfig("temp_out", "Temp", "°C", sudden_change=5.0, low=-10, high=40, variance_floor=0.5),
    VariableConfig("out_hum", "Humidity", "%", low=0, high=100, variance_floor=5.0),
    VariableConfig("wind_speed", "Wind", "km/h", low=0, high=100, variance_floor=0.1),
    VariableConfig("bar", "Pressure", "hPa", sudden_change=10.0, low=950, high=1050, variance_floor=0.1),
)
RAIN = VariableConfig("rain", "Rain", "mm", low=0, high=50)
WIND_DIR = VariableConfig("wind_dir", "Wind direction", "°", low=0, high=360)

DETECTED = tuple(v.name for v in VARIABLES)
PROFILED = (*DETECTED, "rain", "wind_dir")

# Readings that sensors emit when they are broken.
SENTINELS = (99.0, 999.9, -127.0, -999.0)

OBSERVATIONS_PER_DAY = 144
EARTH_RADIUS_KM = 6371.0


def per_variable(attribute: str, configs=VARIABLES, variable: str = "variable") -> Column:
    """The configured attribute of each row's variable (NULL where none is set)."""
    known = [(c.name, getattr(c, attribute)) for c in configs if getattr(c, attribute) is not None]
    pairs = [F.lit(x) for name, value in known for x in (name, float(value))]
    return F.try_element_at(F.create_map(*pairs), F.col(variable))


def parse_time(value: str | datetime | None, now: datetime | None = None) -> datetime | None:
    """``NOW`` in any case, a datetime, or an ISO string; times with an offset become UTC without one."""
    if isinstance(value, str):
        value = (now or datetime.now(timezone.utc)) if value.upper() == "NOW" else datetime.fromisoformat(value)
    if value is not None and value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


@dataclass(frozen=True)
class TimeRange:
    """``[start, end]``, given in full or as the hours before ``end``."""

    start: datetime
    end: datetime
    closed: str = field(default="both")  # "both" or "left"

    @classmethod
    def resolve(cls, start=None, end=None, hours: float | None = None, closed: str = "both",
                now: datetime | None = None) -> "TimeRange":
        start, end = parse_time(start, now), parse_time(end, now)
        if end is not None and start is not None:
            return cls(start, end, closed)
        if end is not None and hours:
            return cls(end - timedelta(hours=hours), end, closed)
        raise ValueError("a time range needs start and end, or end and hours")

    def contains(self, time: str = "time") -> Column:
        lower = F.col(time) >= ntz(self.start)
        upper = F.col(time) <= ntz(self.end) if self.closed == "both" else F.col(time) < ntz(self.end)
        return lower & upper

    @property
    def hours(self) -> float:
        return (self.end - self.start).total_seconds() / 3600


def ntz(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
