"""Text rules and joins that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.scale import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

# Ids (some 20 bytes each) that may be broadcast: about 20 MB. More go through a shuffle.
BROADCAST_IDS = 1_000_000


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold_case(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def joined(big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """Join on ``key``, null matching null; ``small`` is broadcast while its counted ``rows`` are few."""
    other = fresh(big, "_key")
    small = small.withColumnRenamed(key, other)
    return big.join(F.broadcast(small) if rows <= BROADCAST_IDS else small,
                    big[key].eqNullSafe(small[other]), how).drop(other)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a whole number that tells its rows apart, and that column's name.

    It is the doc_id itself where none is null or repeated; else rows are numbered in a written copy.
    """
    if isinstance(df.schema["doc_id"].dataType, IntegralType):
        odd = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | F.col("doc_id").isNull())
        if odd.isEmpty():
            row = fresh(df, "_row")
            return df.withColumn(row, F.col("doc_id").cast("long")), row
    return numbered(df)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a written table with a number for each row, so that repeated rows can be told apart; the column's name."""
    row = fresh(df, "_row")
    return settle(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


Worker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Give this process's free memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Worker) -> Worker:
    """``run``, giving free memory back to the machine when a task's rows end: the worker stays for tasks of other stages, beside theirs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows
