"""Line deduplication with levelled sorted runs.

Documents come in batches of ascending doc_id. What earlier batches held is kept as runs: sorted tables of line digests.
A batch's distinct digests are merged against the runs: those found there are old; the others get the smallest doc_id
of the batch and become a run of level 0. When a level holds ``fanout`` runs they are compacted into one run of the next
level. So a batch reads every digest seen before once, and each digest is rewritten once per level.

A key is a line without blanks (space, tab to carriage return) at its ends, with A-Z lowered; keys of ``min_chars`` code
points or more are compared by their MD5 digest (128 bits). The lines of a key stay in the smallest doc_id that holds it,
all of them, and go everywhere else. Null or empty text: one empty line, which stays. A null doc_id comes after all others.
Rows that repeat a doc_id are one document for counting, and each keeps or loses its own lines. Empty tables give empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import settle
from .text import BLANKS, fold_case, numbered, whole

MIN_CHARS = 10
BATCHES = 6
FANOUT = 3
LAST = 2**63 - 1


def split_lines(text: str = "text") -> Column:
    return F.split(whole(text), "\n", -1)


def keyed_lines(docs: DataFrame, row: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, row, line (0-based) and the digest of every line that is long enough."""
    lines = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col(row).alias("row"),
                        F.posexplode(split_lines()).alias("line", "text"))
    key = fold_case(F.btrim("text", F.lit(BLANKS)))
    return lines.select("id", "row", "line", key.alias("key")).where(F.length("key") >= min_chars).select(
        "id", "row", "line", F.unhex(F.md5(F.col("key").cast("binary"))).alias("digest"))


class Runs:
    """Sorted runs of (digest) by level; every digest is in one of them."""

    def __init__(self, fanout: int = FANOUT):
        self.levels: list[list[DataFrame]] = []
        self.fanout = fanout

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, digests: DataFrame, level: int = 0) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        n = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        run = settle(digests.select("digest").repartition(n, "digest").sortWithinPartitions("digest"), f"run{level}")
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self.add(reduce(DataFrame.unionByName, runs), level + 1)


def judge(lines: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """row and line of every line that goes. ``lines``: what keyed_lines gives, as a written table."""
    cuts = lines.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()[0]
    bounds = [None, *sorted(set(cuts or [])), None]
    runs, gone = Runs(fanout), []
    for low, high in zip(bounds, bounds[1:]):
        part = lines
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        keys = part.groupBy("digest").agg(F.min("id").alias("first"))
        seen = runs.all()
        old = F.lit(False) if seen is None else F.col("_digest").isNotNull()
        if seen is not None:
            seen = seen.withColumnRenamed("digest", "_digest")
            keys = keys.join(seen, F.col("digest") == F.col("_digest"), "left")
        keys = settle(keys.select("digest", "first", old.alias("old")), "keys")
        if high is not None:
            runs.add(keys.where(~F.col("old")))
        gone.append(part.join(keys, "digest").where(F.col("old") | (F.col("id") > F.col("first"))).select("row", "line"))
    return reduce(DataFrame.unionByName, gone)


def drop_repeated(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the ``kept`` text of every row of ``docs`` (doc_id, text)."""
    rows, row = numbered(docs.select("doc_id", "text"))
    lines = settle(keyed_lines(rows, row, min_chars), "lines")
    gone = judge(lines, batches, fanout).groupBy(F.col("row").alias("_gone_row")).agg(F.collect_list("line").alias("_gone"))
    marked = rows.join(gone, F.col(row) == F.col("_gone_row"), "left").select(
        "doc_id", whole("text").alias("text"), split_lines().alias("lines"),
        F.coalesce("_gone", F.array().cast("array<int>")).alias("gone"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return marked.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(
            F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")).alias("kept"))
