"""Document fingerprints: threshold-scaled sketches.

A sketch is the sorted set of those shingle hashes (five words) that lie below a fixed fraction of the hash range. Sketches of
documents of any length are samples of the same hashes, so the union of two sketches is the sketch of both texts together
(``merge``), and their intersection estimates how much of the smaller is contained in the larger. A document whose hashes all
lie above the threshold keeps its smallest one, so only texts without words have an empty sketch. Such a text is blind: a text that
holds it whole and has hashes below the threshold shares nothing with it. At one half that is one text of n shingles in 2^n.

Words are runs of other than blanks, with A-Z lowered; fewer than five words make one shingle. Null counts as empty. Two
empty sketches are alike (1), an empty one and another are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import settle
from .text import fold_case, whole

WORDS = 5
# One shingle hash in FRACTION is kept.
FRACTION = 2
THRESHOLD = -(2**63) + 2**64 // FRACTION
SEPARATOR = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column) -> Column:
    """Sorted distinct shingle hashes below the threshold, as array<bigint>."""
    words = F.transform(F.filter(F.split(fold_case(text), SEPARATOR), lambda w: w != ""), lambda w: F.xxhash64(w))
    n = F.size

    def shingles(w: Column) -> Column:
        starts = F.sequence(F.lit(0), n(w) - WORDS)
        many = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        return F.when(n(w) >= WORDS, many).when(n(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    def retained(h: Column) -> Column:
        low = F.filter(h, lambda x: x < THRESHOLD)
        return F.when(n(low) > 0, low).when(n(h) > 0, F.array(F.array_min(h))).otherwise(h)

    return let(words, lambda w: let(shingles(w), lambda h: F.array_sort(F.array_distinct(retained(h)))))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < THRESHOLD)
        return F.when(F.size(low) > 0, low).otherwise(F.slice(h, 1, 1))

    return let(F.array_sort(F.array_union(a, b)), kept)


def _ratio(a: Column, b: Column, of: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(common / of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other has too."""
    return _ratio(a, b, F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return _ratio(a, b, F.size(F.array_union(a, b)))


def encoded(s: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], per_task: int = 4) -> DataFrame:
    """``docs`` (doc_id and ``columns``) with ``next``: those columns of the document after it by descending doc_id (nulls last,
    ties by descending columns), and after the last those of the first.

    Ranges of ids, more of them than tasks, are windows of their own. The first document of every range is found by its id and
    handed to the range before.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * per_task
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    bounds = F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<bigint>")
    # Range 0 has the largest ids, nulls have the last one.
    place = F.coalesce(F.size(F.filter(bounds, lambda c: F.col("doc_id") <= c)), F.lit(0))
    ranges = docs.select("*", F.when(F.col("doc_id").isNull(), n).otherwise(place).alias("range"))
    first = ranges.groupBy("range").agg(F.max("doc_id").alias("top"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    first = settle(first.select("range", "top", before.alias("before")), "ranges")  # a row for each range
    given = F.broadcast(first.withColumnRenamed("range", "_range"))
    heads = ranges.join(given, (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy(
        F.col("before").alias("_before")).agg(F.max(F.struct(*columns)).alias("head"))
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), *[F.desc(c) for c in columns])
    chain = ranges.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return chain.join(heads, F.col("range") == F.col("_before"), "left").withColumn(
        "next", F.coalesce("next", "head")).drop("head", "_before", "range")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Sketches of every document of ``docs`` (doc_id, text), of its edited text and of the next one's text, and their likeness.

    The edited text ends in the beginning of the next document's text, from the half on.
    """
    rows = docs.select("doc_id", whole("text").alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    # Only texts are moved; sketches of a text are about as long and cannot be packed, so the next one's is made again.
    pairs = with_next(rows, ["text"]).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text")).alias("sketch"),
        sketch(F.col("next.text")).alias("next_sketch"), edited.alias("edited"))
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited")))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch",
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        jaccard(F.col("sketch"), F.col("edited_sketch")).alias("jaccard_edited"))
