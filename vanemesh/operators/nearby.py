"""Neighbourhoods without a table of edges.

A network has more edges than stations by far, and what is computed around a station needs the readings of all its neighbours: a table
of edges, let alone of readings copied for every edge, grows with the square of the stations. ``spatial.neighbors`` therefore notes how
its edges came about. Operators that get such edges send each block of stations, those within reach of it, and their readings to one
task, which finds the neighbours there. Blocks are bands of latitude (and ranges of time); a reading is copied for the few blocks that
it reaches, not for each neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import EARTH_RADIUS_KM
from ..functions import nearby as kernel
from ..functions.columns import micros
from .scale import SMALL_ROWS, keep, settle

# Readings of one block, which a Python worker holds.
BLOCK_READINGS = 2_000_000
# Stations with their numbers that may be broadcast: some 30 MB.
NUMBERED_ROWS = 500_000
# Rows that a task hands on at once.
OUT_ROWS = 200_000


@dataclass(frozen=True)
class Near:
    """What edges were made from: placed stations and limits."""

    stations: DataFrame
    max_km: float
    max_elev: float | None
    pass_unknown: bool

    @property
    def reach(self) -> float:
        """Degrees of latitude."""
        return math.degrees(self.max_km / EARTH_RADIUS_KM) * 1.0001


def noted(df: DataFrame, **notes) -> DataFrame:
    """``df`` with a note on how it came about; whatever is made from it has none."""
    df.__dict__["_notes"] = notes
    return df


def note(df: DataFrame, name: str):
    return df.__dict__.get("_notes", {}).get(name)


@dataclass(frozen=True)
class Block:
    """One block inside a task: places and names of its stations (in order of their ids), the other rows as Arrow columns."""

    near: tuple
    stations: pa.Table
    readings: pa.Table
    asked: pa.Table

    def opened(self) -> tuple[kernel.Places, kernel.Readings, pa.Array, np.ndarray]:
        """Places, readings, names, and the stations asked for; all by place of their id in the order of ids."""
        sid = self.stations.column("sid").to_numpy()
        more = self.stations.column("more").combine_chunks()
        more = more.chunk(0) if isinstance(more, pa.ChunkedArray) else more
        numbers, first = np.unique(sid, return_index=True)
        names = more.field("station_id").take(pa.array(first))
        order = np.array(sorted(range(len(names)), key=names.to_pylist().__getitem__), np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = lambda table: rank[np.searchsorted(numbers, table.column("sid").to_numpy())]
        lat, lon = (more.field(c).to_numpy(zero_copy_only=False) for c in ("latitude", "longitude"))
        elevation = more.field("elevation")
        places = kernel.Places(
            place(self.stations), lat, lon, elevation.fill_null(0.0).to_numpy(zero_copy_only=False),
            elevation.is_valid().to_numpy(zero_copy_only=False), *self.near)
        value = self.readings.column("value").combine_chunks()
        readings = kernel.Readings(
            np.arange(len(names)), place(self.readings), self.readings.column("t").to_numpy(),
            value.fill_null(0.0).to_numpy(), value.is_valid().to_numpy(zero_copy_only=False))
        return places, readings, names.take(pa.array(order)), place(self.asked)

    def column(self, name: str) -> pa.Array:
        """A column of what is asked."""
        more = self.asked.column("more").combine_chunks()
        return (more.chunk(0) if isinstance(more, pa.ChunkedArray) else more).field(name)


def run_blocks(rows: DataFrame, near: Near, fn: Callable[[Block], Iterator[dict]], schema: str | StructType, blocks: int) -> DataFrame:
    """``fn`` for each block of ``rows`` (block, kind, sid, t, value, more), as a stream; it yields columns of the schema."""
    limits = near.max_km, near.max_elev, near.pass_unknown
    ddl = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(ddl)

    def found(parts: list[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        if parts[0] and parts[2]:
            few = ["sid", "t", "value"]
            readings = pa.Table.from_batches(parts[1]) if parts[1] else pa.Table.from_batches(parts[2]).slice(0, 0).select(few)
            for columns in fn(Block(limits, pa.Table.from_batches(parts[0]), readings, pa.Table.from_batches(parts[2]))):
                yield pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type)
                                       for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, current = [[], [], []], None
        for batch in batches:
            number, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if number[a] != current:
                    yield from found(parts)
                    parts, current = [[], [], []], number[a]
                piece = batch.slice(a, b - a)
                # What stands in ``more`` is empty for readings, and they are many.
                parts[kind[a]].append(piece.select(["sid", "t", "value"]) if kind[a] == 1 else piece)
        yield from found(parts)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(max(n, 2 * blocks), 10 * n)
    return rows.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, ddl)


class Bands:
    """Bands of latitude that hold no more than a share of the stations, as far as the reach allows; ``share`` 1 or more: one band."""

    def __init__(self, near: Near, share: float):
        self.reach, self.height = near.reach, None
        if share >= 1:
            return
        base = max(near.reach, 0.1)
        rows = near.stations.groupBy(F.floor(F.col("latitude") / base).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        count, total = {r.b: r.n for r in rows}, sum(r.n for r in rows)
        split = near.stations.groupBy("station_id").agg(F.min("latitude").alias("a"), F.max("latitude").alias("b")).where("a <> b")
        if not total or not split.isEmpty():  # a station with several places stays in one block
            return
        for k in (64, 32, 16, 8, 4, 2, 1):
            held: dict[int, int] = {}
            for b, n in count.items():
                for block in {(b + d) // k for d in (-1, 0, 1)}:
                    held[block] = held.get(block, 0) + n
            if max(held.values()) <= share * total or k == 1:
                self.height = k * base
                return

    def home(self, latitude: str) -> Column:
        return F.lit(0).cast("long") if self.height is None else F.floor(F.col(latitude) / self.height).cast("long")

    def around(self, latitude: str) -> Column:
        if self.height is None:
            return F.array(F.lit(0).cast("long"))
        return F.sequence(*[F.floor((F.col(latitude) + d) / self.height).cast("long") for d in (-self.reach, self.reach)])


_MORE = ("station_id", "latitude", "longitude", "elevation")


class Spread:
    """Blocks of stations, with numbers in place of ids."""

    def __init__(self, near: Near, share: float):
        self.near, self.bands = near, Bands(near, share)
        numbered = near.stations.select("station_id").distinct().withColumn("sid", F.monotonically_increasing_id())
        numbers, n = keep(numbered)
        placed = settle(near.stations.join(self._small(numbers, n), "station_id"), "places")
        self.placed = placed.select("sid", *_MORE, self.bands.home("latitude").alias("band"), self.bands.around("latitude").alias("bands"))
        homes = self.placed.groupBy("station_id", "sid").agg(F.min("band").alias("band"), F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands"))
        self.homes = self._small(homes, n)

    @staticmethod
    def _small(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= NUMBERED_ROWS else df

    def rows(self, asked: DataFrame, readings: DataFrame | None, keys: list[str], extra: list[str], fn, schema) -> DataFrame:
        """``fn`` over the blocks of ``asked`` (keys, band, sid, t, extra).

        ``asked`` says in ``copies`` how often a row of it comes. ``readings`` (keys, station_id, t, value, each row once for each value of its keys that it belongs to) go to the blocks around
        their station.
        """
        blocks, n = keep(asked.select(*keys, "band").distinct().withColumn("block", F.monotonically_increasing_id()))
        small = F.broadcast(blocks) if n <= SMALL_ROWS else blocks
        kinds = {f.name: f.dataType for f in asked.schema.fields}

        def shaped(df: DataFrame, kind: int, t: Column, value: Column, given: list[str]) -> DataFrame:
            more = [F.col(c).alias(c) if c in given else F.lit(None).cast(t_).alias(c)
                    for c, t_ in [*((c, self.placed.schema[c].dataType) for c in _MORE), *((c, kinds[c]) for c in extra)]]
            whole = F.struct(*more)
            return df.select("block", F.lit(kind).alias("kind"), "sid", t.cast("long").alias("t"), value.cast("double").alias("value"),
                             (whole if given else F.when(F.lit(False), whole)).alias("more"))

        none = F.lit(None)
        stations = self.placed.withColumn("band", F.explode("bands")).join(small.select("block", "band"), "band")
        out = shaped(stations, 0, F.lit(0), none, list(_MORE)).unionByName(
            shaped(asked.join(small, [*keys, "band"]), 2, F.col("t"), F.col("copies"), extra))
        if readings is not None:
            near = readings.join(self.homes.select("station_id", "sid", "bands"), "station_id").withColumn("band", F.explode("bands"))
            out = out.unionByName(shaped(near.join(small, [*keys, "band"]), 1, F.col("t"), F.col("value"), []))
        return run_blocks(out, self.near, fn, schema, n)


def around_each(asked: DataFrame, long: DataFrame, near: Near, width: int, fn, schema: StructType, limit: int = BLOCK_READINGS) -> DataFrame:
    """``fn`` over the blocks of anomalies ``asked`` (``a_station, variable, a_time``; a written table) with the readings up to ``width``
    microseconds around them."""
    asked = asked.where(F.col("variable").isNotNull() & F.col("a_time").isNotNull()).groupBy("a_station", "variable", "a_time").agg(
        F.count(F.lit(1)).alias("copies")).withColumn("t", micros("a_time"))
    readings = long.where(F.col("time").isNotNull()).select("station_id", "variable", micros("time").alias("t"), F.col("value").cast("double").alias("value"))
    first, last = asked.agg(F.min("t"), F.max("t")).first()
    unit = max(width, ((last or 0) - (first or 0)) // 2000, 1)
    near_asked = readings.where(F.col("t").between((first or 0) - width, (last or 0) + width))
    most = near_asked.groupBy("variable", F.floor(F.col("t") / unit)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    # A block is some units of time long and takes in the one before and behind it.
    units = min(max(limit // most - 2, 2), 8)
    spread = Spread(near, limit / ((units + 2) * most))
    length = F.lit(units * unit)

    def chunk(t: Column) -> Column:
        return F.floor(t / length).cast("long")

    t = F.col("t")
    placed = asked.join(spread.homes.select(F.col("station_id").alias("a_station"), "sid", "band"), "a_station").withColumn("chunk", chunk(t))
    spans = near_asked.withColumn("chunk", F.explode(F.sequence(chunk(t - width), chunk(t + width))))
    return spread.rows(placed, spans, ["variable", "chunk"], ["a_station", "variable", "a_time"], fn, schema)


def anomaly_schema(asked: DataFrame, more: str) -> StructType:
    kinds = [asked.schema[c] for c in ("a_station", "variable", "a_time")]
    return StructType([*kinds, *StructType.fromDDL(more).fields])


def each_anomaly(width: int, fn: Callable[[kernel.Around, int, int, int], dict | None]):
    """A function of blocks from one of single anomalies: ``fn(around, station, time, copies)`` gives columns, or None for no row.

    Stations are given by their places, one (a column whose name ends in ``_at``) or a list (``_all``) a row.
    """

    def run(block: Block) -> Iterator[dict]:
        places, readings, names, stations = block.opened()
        around = kernel.Around(places, readings, width)
        time, copies = block.asked.column("t").to_numpy(), block.asked.column("value").to_numpy()
        keys = {c: block.column(c) for c in ("a_station", "variable", "a_time")}
        held, index, size = [], [], 0

        def given() -> dict:
            rows = pa.array(np.concatenate(index))
            out = {c: v.take(rows) for c, v in keys.items()}
            for name in held[0]:
                values = [h[name] for h in held]
                if name.endswith("_at"):
                    out[name[:-3]] = names.take(pa.array(np.concatenate(values)))
                elif name.endswith("_all"):
                    ends = np.concatenate([[0], np.cumsum([len(v) for x in values for v in x])])
                    flat = np.concatenate([v for x in values for v in x])
                    out[name[:-4]] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), names.take(pa.array(flat.astype(np.int64))))
                else:
                    out[name] = np.concatenate(values) if not isinstance(values[0], np.ma.MaskedArray) else pa.array(
                        np.concatenate([v.data for v in values]), mask=np.concatenate([np.ma.getmaskarray(v) for v in values]))
            return out

        # In order of time, so that anomalies of one time share what is computed for all stations.
        for k in np.argsort(time, kind="stable"):
            found = fn(around, int(stations[k]), int(time[k]), int(copies[k]))
            if found is None:
                continue
            n = len(next(iter(found.values())))
            if not n:
                continue
            held.append(found)
            index.append(np.full(n, k))
            size += n + sum(len(v) for name, x in found.items() if name.endswith("_all") for v in x)
            if size >= OUT_ROWS:
                yield given()
                held, index, size = [], [], 0
        if held:
            yield given()

    return run


def linked_stations(near: Near) -> DataFrame:
    """``station_id`` of the stations that have an edge."""

    def run(block: Block) -> Iterator[dict]:
        places, _, names, stations = block.opened()
        some = [int(i) for i in stations if any(len(places.around(r)) for r in places.rows[i])]
        yield {"station_id": names.take(pa.array(some, pa.int64()))}

    spread = by_parts(near)
    return spread.rows(parted(spread, parts_of(spread)), None, ["part"], ["variable"], run, f"station_id {near.stations.schema['station_id'].dataType.simpleString()}")


# Stations of a block that are looked at without their series.
BLOCK_STATIONS = 200_000


def by_parts(near: Near) -> Spread:
    return Spread(near, BLOCK_STATIONS / max(near.stations.count(), 1))


def parts_of(spread: Spread) -> int:
    return max(1, min(spread.homes.count() // 500, 32))


def parted(spread: Spread, parts: int) -> DataFrame:
    """Every station once, in parts that share their band's stations."""
    return spread.homes.select("sid", "station_id", "band", F.lit(0).alias("t"), F.lit(1).alias("copies"), F.lit(None).cast("string").alias("variable"),
                               F.pmod(F.xxhash64("sid"), F.lit(parts)).alias("part"))
