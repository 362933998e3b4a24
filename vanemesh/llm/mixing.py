"""Mixing sources to target weights by pivotal rounding.

Every source gets a target in words. A document's expected copies are target / source size, at most 3; the whole part
is certain, the fraction is rounded dependently: two documents of a source meet, words move from one to the other
(in a random direction, so that expectations stay) until one of the fractions is 0 or 1, and the other goes on. The sum of
words is kept by every meeting. Documents meet first in small buckets by hash; the one left over in each bucket goes
up a reduction tree of such buckets until one per source is left, which is rounded by its own probability. So a source
misses its target by less than one document, and no source, however large, meets in one task.

All randomness is a hash of the rows and the seed: reruns agree. Rows that repeat are separate documents. A null or empty
text has size 0, takes no words and gets the expected copies rounded on its own. Null is a source of its own, the last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import keep, settle
from .text import WORD, fresh, joined, keyed, whole

# Documents that meet in one bucket of the tree, and children of a node.
BUCKET = 128
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)


def ranked(df: DataFrame, column: str) -> DataFrame:
    """1-based rank of distinct values in code point order, nulls last: counts of sorted ranges are added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(df.repartitionByRange(n, F.asc_nulls_last(column)).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last(column))
    return parts.withColumn("rank", F.row_number().over(inside)).join(before, "part").withColumn(
        "rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size, docs) with ``target``: shares by weight, filled up to ``max_copies`` times the size.

    A level rises until the capped sources and the level times the weights of the others make up all words.
    """
    table = settle(ranked(sizes, "source").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))),
        "sources")
    most = F.col("source_size") * F.lit(max_copies)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = most < F.col("weight") * F.lit(level)
        full, weight, n = table.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - full) / weight
    return table.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(float(level)))).drop("rank")


def uniform(a: int, b: int) -> float:
    """A number in [0, 1) from two 64-bit hashes."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = (x * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    return (x >> 11) / 2**53


def meet(size: np.ndarray, p: np.ndarray, h: np.ndarray, level: int) -> np.ndarray:
    """Fractions after all documents of a bucket have met in turn; at most one of them is strictly between 0 and 1."""
    p = p.astype(float).copy()
    open_, a, keys = None, size.astype(float), [int(x) & 0xFFFFFFFFFFFFFFFF for x in h]
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if open_ is None:
            open_ = j
            continue
        i = open_
        to_i, to_j = (1 - p[i]) * a[i], (1 - p[j]) * a[j]
        one, two = min(to_i, p[j] * a[j]), min(p[i] * a[i], to_j)
        if uniform(keys[i] + level, keys[j]) * (one + two) < two:  # words move from j to i
            full_i = to_i <= p[j] * a[j]
            p[i], p[j] = (1.0, p[j] - one / a[j]) if full_i else (p[i] + one / a[i], 0.0)
        else:
            full_j = to_j <= p[i] * a[i]
            p[j], p[i] = (1.0, p[i] - two / a[i]) if full_j else (p[j] + two / a[j], 0.0)
        p[[i, j]] = np.where(p[[i, j]] < 1e-12, 0.0, np.where(p[[i, j]] > 1 - 1e-12, 1.0, p[[i, j]]))
        open_ = next((k for k in (i, j) if 0 < p[k] < 1), None)
    return p


def meetings(level: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        p = meet(*(group.column(c).to_numpy() for c in ("size", "p", "h")), level)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p))

    return run


def round_copies(rows: DataFrame, largest: int, bucket: int = BUCKET) -> DataFrame:
    """``rows`` (source, docs, size, p, h and more) with ``p`` rounded to 0 or 1.

    ``largest``: documents of the largest source, which sets the height of the tree.
    """
    columns = rows.columns
    chance = F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    coin = F.when(chance < F.col("p"), 1.0).otherwise(0.0)
    meets = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    done = [rows.where(~meets).withColumn("p", F.when((F.col("p") > 0) & (F.col("p") < 1), coin).otherwise(F.col("p")))]
    rest = rows.where(meets).withColumn(
        "node", F.pmod(F.col("h"), F.ceil(F.col("docs") / F.lit(bucket)).cast("long")))
    nodes, level = -(-largest // bucket), 0
    while True:
        out = settle(rest.groupBy("source", "node").applyInArrow(meetings(level), rest.schema), "meetings")
        left = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~left).select(*columns))
        rest = out.where(left).withColumn("node", F.floor(F.col("node") / F.lit(bucket)))
        if nodes <= 1:
            break
        nodes, level = -(-nodes // bucket), level + 1
    done.append(rest.withColumn("p", coin).select(*columns))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def plan(rows: DataFrame, max_copies: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """``rows`` (id, key, source, size; a written table) with source_size, target and ``copies``.

    ``key`` is what the randomness hangs on: the same for the same document in every run.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    table, n = keep(targets(sizes, max_copies))
    largest = table.agg(F.max("docs")).first()[0] or 0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = joined(rows, table.drop("weight"), "source", n).withColumns(
        {"whole": F.floor(expected).cast("int"), "p": expected - F.floor(expected),
         "h": F.xxhash64(F.lit(seed), "key", "size")}).drop("key")
    return round_copies(ready, largest).withColumn("copies", F.col("whole") + F.col("p").cast("int")).drop("whole", "p", "h", "docs")


def words(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs`` (doc_id, text, source)."""
    rows = settle(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), "source", words("text").alias("size")), "sizes")
    return plan(rows).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    rows, row = keyed(docs)
    copies = fresh(rows, "_copies")
    sizes = settle(rows.select(F.col(row).alias("id"), F.xxhash64("doc_id", whole("text")).alias("key"), "source",
                               words("text").alias("size")), "sizes")
    picked = plan(sizes).where(F.col("copies") > 0).select(F.col("id").alias(row), F.col("copies").alias(copies))
    picked, n = keep(picked)
    return joined(rows, picked, row, n).withColumn(
        copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(row, copies)
