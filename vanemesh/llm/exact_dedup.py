"""Exact deduplication with a heavy-hitter split.

Equal texts have equal SHA-256 digests of the normalised text (A-Z lowered, null as empty). Misra-Gries summaries
of the partitions are merged into at most ``capacity`` candidate digests; their exact counts and largest ids are
verified and broadcast, so that the rows of a huge group never meet in one task. All other digests, each with at
most 2/capacity of the rows, go through an ordinary shuffle.

Nulls and ties: a null text equals an empty one; a null doc_id is smaller than any other; of rows that repeat the
largest doc_id of a group exactly one stays. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import keep, settle
from .text import fold_case, joined, keyed, whole

# Counters of a summary. Winners are at most as many: some 100 bytes each, 0.4 MB to broadcast.
CAPACITY = 4096


def merge_counts(counts: dict, more: dict, capacity: int) -> dict:
    """Misra-Gries merge: add, then take the (capacity+1)-th largest count off all and drop what is used up."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) <= capacity:
        return counts
    off = sorted(counts.values(), reverse=True)[capacity]
    return {k: n - off for k, n in counts.items() if n > off}


def summaries(rows: DataFrame, key: str, capacity: int) -> DataFrame:
    """One Misra-Gries summary per partition: ``key`` and a lower bound of its count there."""
    kind = pa.binary() if rows.schema[key].dataType.simpleString() == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            found = batch.column(0).value_counts()
            more = dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True))
            counts = merge_counts(counts, more, capacity)
        yield pa.record_batch([pa.array(list(counts), kind), pa.array(list(counts.values()), pa.int64())], [key, "n"])

    return rows.select(key).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n long")


def groups(rows: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (key, doc_id, seq; a settled table) with ``keep`` (doc_id and seq of the row that stays) and ``group_size``."""
    total = rows.count()
    found = summaries(rows, key, capacity).groupBy(key).agg(F.sum("n").alias("n"))
    # The lower bounds add up to at most all rows, so at most ``capacity`` digests pass.
    candidates = found.where(F.col("n") >= F.lit(max(2.0, total / capacity))).select(key)
    winners = settle(
        rows.join(F.broadcast(settle(candidates, "candidates")), key)
        .groupBy(key).agg(F.max(F.struct("doc_id", "seq")).alias("keep"), F.count(F.lit(1)).alias("group_size")),
        "winners")
    split = rows.join(F.broadcast(winners), key, "left")
    heavy = split.where(F.col("group_size").isNotNull())
    w = Window.partitionBy(key)
    light = split.where(F.col("group_size").isNull()).withColumns({
        "keep": F.max(F.struct("doc_id", "seq")).over(w), "group_size": F.count(F.lit(1)).over(w)})
    return heavy.unionByName(light)


def digested(docs: DataFrame, *columns: str) -> DataFrame:
    """The digest of every normalised text, next to ``columns``."""
    return docs.select(*columns, F.unhex(F.sha2(fold_case(whole("text")).cast("binary"), 256)).alias("digest"))


def resolve(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    rows = settle(digested(docs, "doc_id").withColumn("seq", F.monotonically_increasing_id()), "digests")
    return groups(rows, "digest", capacity).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("seq") == F.col("keep.seq")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedupe(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    whole_rows, row = keyed(docs)
    rows = settle(digested(whole_rows, "doc_id", row).withColumnRenamed(row, "seq"), "digests")
    found = groups(rows, "digest", capacity)
    gone, n = keep(found.where(F.col("seq") != F.col("keep.seq")).select(F.col("seq").alias(row)))
    return joined(whole_rows, gone, row, n, "left_anti").drop(row)
