"""Building blocks that keep one hot series from landing in one task.

A station or a series may hold a third of all rows. Group statistics are merged from partial
aggregates and joined back with ``attach``; ordered operators cut a series into parts by time or by
position and carry the little they need across the cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import time_bucket
from ..session import run_folder

# Rows of narrow group statistics (about 100 bytes each) that may be broadcast: some 20 MB.
SMALL_ROWS = 200_000
# A key is hot when it holds more than this share of all rows, so there are fewer than 1000 hot keys.
HOT_SHARE = 1 / 1000
# Rows of one series that a part in time order should hold.
PART_ROWS = 1_000_000


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    It survives lost executors, and the plans of the steps that read it start here.
    """
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def keep(df: DataFrame) -> tuple[DataFrame, int]:
    """Settle group statistics that several later steps read, and count them (from the file footers)."""
    df = settle(df, "kept")
    return df, df.count()


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str],
           rows: int | None = None, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Inner join of ``big`` with the rows of ``small`` per key (one row, or a few of the same weight).

    ``small`` is broadcast when its counted rows fit. Otherwise both sides shuffle, and the keys whose
    ``weight`` (rows in ``big``) exceeds a thousandth of the total are spread over several tasks by a
    hash of the ``spread`` columns; there are fewer than 1000 such keys, which bounds that broadcast.
    """
    keys = list(keys)
    if rows is None:
        small, rows = keep(small)
    if rows <= small_rows:
        return big.join(F.broadcast(small), keys)
    total = small.agg(F.sum(weight)).first()[0] or 0
    per_task = max(total * HOT_SHARE, 1.0)
    parts = F.ceil(F.col(weight) / F.lit(per_task)).cast("int")
    hot = small.where(F.col(weight) > per_task).select(*keys, parts.alias("_parts")).distinct()
    salted_big = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    salted_small = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    )
    return salted_big.join(salted_small, [*keys, "_salt"]).drop("_salt", "_parts")


def _by_task(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle groups into as many tasks as the session has shuffle partitions.

    Python work is heavy for its bytes: Spark would merge such groups into a few tasks by size, or reuse a
    partitioning that was merged before. The hash column is there to rule both out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_task", F.xxhash64(*keys)).repartition(n, *keys, "_task")


def apply_grouped(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                  fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str,
                  order: str | None = None) -> DataFrame:
    """Run a numpy function per key, spread over all tasks.

    ``fn`` gets the named columns as arrays, sorted by ``order``, and returns the columns of the schema; those
    it leaves out are the group's keys, repeated.
    """
    keys, columns = list(keys), list(columns)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        cols = {c: _array(table.column(c)) for c in columns}
        if order:
            rank = np.argsort(cols[order], kind="stable")
            cols = {c: v[rank] if isinstance(v, np.ndarray) else [v[i] for i in rank] for c, v in cols.items()}
        out = fn(cols)
        n = len(next(iter(out.values())))
        return pa.table([
            pa.array(out[f.name], type=f.type, from_pandas=True) if f.name in out
            else pa.repeat(table.column(f.name)[0], n).cast(f.type) for f in target
        ], schema=target)

    selected = df.select(*keys, *[c for c in columns if c not in keys])
    return _by_task(selected, keys).groupBy(*keys, "_task").applyInArrow(run, schema)


def ddl_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _array(column: pa.ChunkedArray) -> np.ndarray | list[np.ndarray]:
    if pa.types.is_list(column.type):
        flat = column.combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        return [flat[i].values.to_numpy(zero_copy_only=False) for i in range(len(flat))]
    return column.to_numpy()


def apply_cogrouped(left: DataFrame, right: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    by = [*keys, "_task"]
    return _by_task(left, keys).groupBy(*by).cogroup(_by_task(right, keys).groupBy(*by)).applyInPandas(
        lambda a, b: fn(a.drop(columns="_task"), b.drop(columns="_task")), schema)


def carry_parts(df: DataFrame, keys: Sequence[str], part: str, aggs: Sequence[Column],
                carried: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Summarise every part of a series, run window functions over the summaries, join them back.

    The window sees one row per part and series, never the rows themselves.
    """
    keys = list(keys)
    summary = df.groupBy(*keys, part).agg(*aggs)
    over_parts = Window.partitionBy(*keys).orderBy(part)
    summary = summary.select(*keys, part, *[f(over_parts).alias(n) for n, f in carried.items()])
    return df.join(summary, [*keys, part])


def time_parts(df: DataFrame, keys: Sequence[str], part_seconds: float | None = None) -> Column:
    """The part of its series a row falls in: time buckets of ``part_seconds``.

    By default the busiest day of any series sets the width, so that no part holds much more than
    ``PART_ROWS``. The day counts are partial aggregates; only their maximum comes to the driver.
    """
    if part_seconds is None:
        days = df.groupBy(*keys, F.to_date("time").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
        busiest = days.agg(F.max("_n")).first()[0] or 1
        part_seconds = max(24 * 3600 * PART_ROWS / busiest, 0.001)
    return time_bucket("time", part_seconds)


def with_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column | None = None,
               name: str = "idx") -> DataFrame:
    """0-based position of each row in its series.

    ``part`` is non-decreasing along ``order`` (a time bucket as a rule); positions inside a part are
    offset by the sizes of the parts before it.
    """
    df = df.withColumn("_part", F.lit(0).cast("long") if part is None else part)
    df = carry_parts(
        df, keys, "_part", [F.count(F.lit(1)).alias("_n")],
        {"_before": lambda w: F.coalesce(
            F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))},
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return df.withColumn(name, F.row_number().over(inside) - 1 + F.col("_before")).drop("_part", "_before")


def with_halo(df: DataFrame, idx: str, size: int, before: int | Column, after: int | Column) -> DataFrame:
    """Cut series into parts of ``size`` positions, each with copies of its neighbours' edges.

    A row goes to the part that owns it and to the parts that reach it: those that need up to ``before``
    positions ahead of their first row and ``after`` behind their last. Adds ``part`` and ``home``.
    """
    i = F.col(idx)
    first = F.greatest(F.floor((i - after) / F.lit(size)), F.lit(0))
    last = F.floor((i + before) / F.lit(size))
    return df.withColumn("part", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn(
        "home", F.col("part") == F.floor(i / F.lit(size)).cast("long")
    )
