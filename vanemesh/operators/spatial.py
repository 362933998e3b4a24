"""Neighbours, links, snapshot outliers and map features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM
from ..functions import nearby as kernel
from ..functions.columns import elevation_adjusted, haversine_km
from .nearby import Block, Near, by_parts, note, noted, parted, parts_of

# Stations of one cell that one task compares with a station of the nine cells around it.
CELL_SHARE = 2_000


def neighbors(stations: DataFrame, max_km: float = 100.0, max_elev: float | None = 500.0,
              null_elev: str = "pass") -> DataFrame:
    """Directed edges ``src, dst, dist_km, elev_diff`` between stations near each other.

    Stations meet by grid cell. Rows of cells are as high as the radius; the cells of a row are as wide as the radius is at the row's
    most polar latitude, so a station near a pole widens the cells of its own row only. Cells are no smaller than one degree; there
    are at most 180 x 360 of them, which bounds the broadcast table of their sizes. Crowded cells are split.
    ``null_elev`` says whether an unknown elevation passes the elevation test.
    """
    s = stations.select("station_id", "latitude", "longitude", "elevation").where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    grid = _Grid(max_km)
    here = s.withColumn("row", grid.row("latitude")).withColumn("col", grid.column("longitude", F.col("row")))
    cells = here.groupBy("row", "col").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(CELL_SHARE)).cast("int").alias("splits")
    )
    dst = here.join(F.broadcast(cells), ["row", "col"]).withColumn(
        "split", F.pmod(F.xxhash64("station_id"), F.col("splits")).cast("int")
    ).select("row", "col", "split", *[F.col(c).alias(f"d_{c}") for c in _GEO])
    around = cells_around(s, max_km).join(F.broadcast(cells), ["row", "col"]).withColumn(
        "split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    gap = F.abs(F.col("elevation") - F.col("d_elevation"))
    pairs = around.join(dst, ["row", "col", "split"]).where(F.col("station_id") != F.col("d_station_id"))
    if max_elev is not None:
        pairs = pairs.where(F.coalesce(gap <= max_elev, F.lit(null_elev == "pass")))
    km = haversine_km("latitude", "longitude", "d_latitude", "d_longitude")
    edges = pairs.select(
        F.col("station_id").alias("src"), F.col("d_station_id").alias("dst"), km.alias("dist_km"),
        (F.col("d_elevation") - F.col("elevation")).alias("elev_diff"),
    ).where(F.col("dist_km") <= max_km)
    return noted(edges, near=near_of(s, max_km, max_elev, null_elev == "pass"))


def near_of(stations: DataFrame, max_km: float, max_elev: float | None, pass_unknown: bool) -> Near:
    """Stations without a number for a place have no edges."""
    usable = stations.where(F.col("station_id").isNotNull() & (F.abs("latitude") < float("inf")) & (F.abs("longitude") < float("inf")))
    return Near(usable.select("station_id", *[F.col(c).cast("double").alias(c) for c in _GEO[1:]]), max_km, max_elev, pass_unknown)


_GEO = ("station_id", "latitude", "longitude", "elevation")


class _Grid:
    """Cells for a radius: rows of equal height, and in each row columns of a width of its own."""

    def __init__(self, max_km: float):
        reach = max_km / EARTH_RADIUS_KM
        self.sine = math.sin(min(reach, math.pi / 2))
        self.height = max(math.degrees(reach) * 1.0001, 1.0)

    def row(self, latitude: str) -> Column:
        return F.floor(F.col(latitude) / self.height).cast("int")

    def reach(self, latitude: Column) -> Column:
        """The degrees of longitude that two places within the radius can lie apart, one of them at ``latitude``."""
        share = F.lit(self.sine) / F.greatest(F.cos(F.radians(latitude)), F.lit(1e-9))
        return F.when(share < 1, F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.0001).otherwise(360.0)

    def columns(self, row: Column) -> Column:
        polar = F.least(F.greatest(F.abs(row * self.height), F.abs((row + 1) * self.height)), F.lit(90.0))
        return F.greatest(F.floor(F.lit(360.0) / F.greatest(self.reach(polar), F.lit(1.0))), F.lit(1)).cast("int")

    def place(self, degrees: Column, row: Column) -> Column:
        """The column, not yet taken round the globe."""
        return F.floor((degrees + 180.0) * self.columns(row) / 360.0).cast("int")

    def column(self, longitude: str, row: Column) -> Column:
        return F.pmod(self.place(F.col(longitude), row), self.columns(row))


def cells_around(stations: DataFrame, max_km: float) -> DataFrame:
    """``stations`` once for each cell, ``row`` and ``col``, in which a neighbour can lie: in the rows above and below too, the columns
    that the station's own reach in longitude touches."""
    grid = _Grid(max_km)
    rows = stations.withColumn("row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: grid.row("latitude") + d)))
    n, row, at, reach = grid.columns(F.col("row")), F.col("row"), F.col("longitude"), grid.reach(F.col("latitude"))
    first, last = grid.place(at - reach, row), grid.place(at + reach, row)
    return rows.withColumn("col", F.explode(F.array_distinct(F.transform(
        F.sequence(first, F.least(last, first + n - 1)), lambda c: F.pmod(c, n)))))


def links(edges: DataFrame) -> DataFrame:
    """Each unordered pair once."""
    return edges.where(F.col("src") < F.col("dst"))


def degrees(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbour count per station, zero for isolated ones."""
    n = edges.groupBy(F.col("src").alias("station_id")).agg(F.count(F.lit(1)).alias("degree"))
    return stations.select("station_id").join(n, "station_id", "left").fillna(0, ["degree"])


def degree_summary(stations: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(stations, edges)
    return d.agg(
        F.count(F.lit(1)).alias("station_count"), (F.sum("degree") / 2).cast("long").alias("connection_count"),
        F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"), F.count_if(F.col("degree") == 0).alias("isolated_count"),
    )


def _around(snapshot: DataFrame, edges: DataFrame, temperature_names) -> DataFrame:
    """The neighbours' adjusted values as seen from each station and variable of the snapshot."""
    theirs = snapshot.where(F.col("value").isNotNull()).select(
        F.col("station_id").alias("dst"), "variable", F.col("value").alias("_theirs"))
    return edges.join(theirs, "dst").select(
        F.col("src").alias("station_id"), "variable",
        elevation_adjusted("_theirs", "elev_diff", F.col("variable"), temperature_names).alias("nb"))


def _centres_around(snapshot: DataFrame, near: Near, min_neighbors: int, temperature_names) -> DataFrame:
    """Median, standard deviation and MAD of the neighbours' values of each station and variable, without a row for each neighbour."""
    theirs = snapshot.where(F.col("value").isNotNull() & F.col("variable").isNotNull())
    variables = sorted(r.variable for r in theirs.select("variable").distinct().collect())
    per_metre = {v: (100, 0.65) if v in temperature_names else (10, 1.2) if v == "bar" else None for v in variables}
    spread = by_parts(near)
    parts = parts_of(spread)
    place = F.array_position(F.array(*map(F.lit, variables)), F.col("variable")) - 1 if variables else F.lit(0)
    readings = theirs.select("station_id", place.alias("t"), F.col("value").cast("double").alias("value"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def centres(block: Block) -> Iterator[dict]:
        places, series, names, stations = block.opened()
        number = series.times[series.code]
        values = {v: kernel.Snapshot(len(names), series.at[number == k], series.value[number == k]) for k, v in enumerate(variables)}
        found = []
        for i in stations.tolist():
            rows = [(r, places.around(r)) for r in places.rows[i]]
            theirs = np.concatenate([r for _, r in rows])
            if not len(theirs):
                continue
            mine = np.repeat([r for r, _ in rows], [len(r) for _, r in rows])
            higher, known = places.elev[theirs] - places.elev[mine], places.known[theirs] & places.known[mine]
            for v, held in values.items():
                nb, at = held.of(places.of[theirs])
                n = len(nb)
                if n < max(min_neighbors, 1):
                    continue
                if per_metre[v]:
                    nb = (nb + higher[at] / per_metre[v][0] * per_metre[v][1])[known[at]]
                found.append((i, v, n, *(kernel.centre(nb) if len(nb) else (None, None, None))))
        i, v, n, middle, sd, mad = zip(*found, strict=True) if found else ((),) * 6
        yield {"station_id": names.take(pa.array(i, pa.int64())), "variable": v, "neighbor_median": middle, "_sd": sd, "n_neighbors": n, "_mad": mad}

    kinds = near.stations.schema["station_id"].dataType.simpleString(), snapshot.schema["variable"].dataType.simpleString()
    return spread.rows(parted(spread, parts), readings, ["part"], ["variable"], centres,
                       f"station_id {kinds[0]}, variable {kinds[1]}, neighbor_median double, _sd double, n_neighbors long, _mad double")


def snapshot_outliers(snapshot: DataFrame, edges: DataFrame, threshold: float = 3.0, min_neighbors: int = 2,
                      temperature_names=("temp",), scale: float = 1.4826) -> DataFrame:
    """Each station's value against the median and MAD of its neighbours at one time.

    A MAD of zero gives way to the population standard deviation, then to 1e-6. With the default
    ``temperature_names`` a column called ``temp_out`` is not adjusted for elevation, ``bar`` is.
    """
    keys = ["station_id", "variable"]
    if (near := note(edges, "near")) is not None:
        centre = _centres_around(snapshot, near, min_neighbors, temperature_names)
    else:
        around = _around(snapshot, edges, temperature_names)
        # A group is one station's neighbourhood; equal values merge before the shuffle.
        centre = around.groupBy(*keys).agg(
            F.median("nb").alias("neighbor_median"), F.stddev_pop("nb").alias("_sd"), F.count(F.lit(1)).alias("n_neighbors"))
        centre = centre.where(F.col("n_neighbors") >= min_neighbors)
        spread = around.join(centre.select(*keys, "neighbor_median"), keys).groupBy(*keys).agg(
            F.median(F.abs(F.col("nb") - F.col("neighbor_median"))).alias("_mad"))
        centre = centre.join(spread, keys)
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-6)
    mad = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(sd)
    return (
        snapshot.where(F.col("value").isNotNull()).join(centre, keys)
        .withColumn("deviation", F.abs(F.col("value") - F.col("neighbor_median")) / (F.lit(scale) * mad))
        .withColumn("is_outlier", F.col("deviation") > threshold).drop("_sd", "_mad")
    )


def distance_class(snapshot: DataFrame, edges: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Failure or weather by the distance from the neighbours, for use when no correlation can be had."""
    judged = snapshot_outliers(snapshot, edges, threshold, 1, scale=1.0)
    return judged.withColumn(
        "distance_type", F.when(F.col("is_outlier"), "critical_failure").otherwise("weather_event"))


def map_nodes(stations: DataFrame, flagged: DataFrame) -> DataFrame:
    """Station points with status and anomaly count; stations without a result are normal."""
    n = flagged.groupBy("station_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return stations.join(n, "station_id", "left").fillna(0, ["anomaly_count"]).withColumn(
        "status", F.when(F.col("anomaly_count") > 0, "anomalous").otherwise("normal"))


def point_feature(properties: list[str]) -> Column:
    """A GeoJSON point feature of a station row."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    ))
