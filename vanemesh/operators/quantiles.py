"""Exact quantiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import attach, keep, settle

# Groups up to this many rows are handled by one ``percentile`` aggregate; larger ones are cut into parts of about as many.
DIRECT_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    frequency: str | None = None, counts: DataFrame | None = None,
                    direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Linearly interpolated quantiles of the non-NULL values: one row per key, one column per entry.

    ``counts`` may bring the (kept) rows per key as ``n``.
    """
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    weight = F.lit(1) if frequency is None else F.col(frequency)
    if counts is None:
        counts, _ = keep(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    top = counts.agg(F.max("n")).first()[0] or 0
    if top <= direct_rows:
        return _direct(df, keys, value, probs, weight)
    sized = attach(df, counts.select(*keys, F.col("n").alias("_n")), keys, "_n", [value])
    small, large = sized.where(F.col("_n") <= direct_rows), sized.where(F.col("_n") > direct_rows)
    return _direct(small, keys, value, probs, weight).unionByName(
        _by_rank(large.drop("_n"), keys, value, probs, weight, -(-top // direct_rows)))


def _direct(df, keys, value, probs, weight):
    q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]), weight)
    return df.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
    )


def value_cuts(values: DataFrame, keys: Sequence[str], value: str, counts: DataFrame, part_rows: int) -> DataFrame:
    """Adds ``_cut``, a part number that grows with the value: 0 throughout a series of up to ``part_rows``
    distinct values (``n`` in ``counts``), approximate quantiles of its values in a longer one."""
    keys = list(keys)
    top = counts.agg(F.max("n")).first()[0] or 0
    if top <= part_rows:
        return values.withColumn("_cut", F.lit(0))
    sized = attach(values, counts.select(*keys, F.col("n").alias("_n")), keys, "_n", [value])
    small, large = sized.where(F.col("_n") <= part_rows), sized.where(F.col("_n") > part_rows).drop("_n")
    cuts = -(-top // part_rows)
    edges, n = keep(_edges(large, keys, value, cuts, F.count(F.lit(1)).alias("_n")))
    large = attach(large, edges, keys, "_n", [value], n, _few(cuts))
    return small.withColumn("_cut", F.lit(0)).drop("_n").unionByName(large.withColumn("_cut", _cut(value)).drop("_edges", "_n"))


def _few(cuts: int) -> int:
    """Lists of so many edges that may be broadcast: 20 MB."""
    return 20_000_000 // (100 + 8 * cuts)


def _edges(values: DataFrame, keys: list[str], value: str, cuts: int, *more) -> DataFrame:
    marks = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    return values.groupBy(*keys).agg(F.percentile_approx(value, marks, cuts * 10).alias("_edges"), *more)


def _cut(value: str):
    return F.when(F.col("_edges").isNotNull(), F.size(F.filter("_edges", lambda e: e <= F.col(value))))


def _by_rank(df, keys, value, probs, weight, cuts):
    """Value counts are cut at approximate quantiles; only the cuts that hold a wanted rank are sorted."""
    counts = settle(df.groupBy(*keys, value).agg(F.sum(weight).alias("_c")), "value_counts")
    edges, n = keep(_edges(counts, keys, value, cuts, F.sum("_c").alias("_total")))
    cut = attach(counts, edges, keys, "_total", [value], n, _few(cuts)).withColumn("_cut", _cut(value))
    by_cut = cut.groupBy(*keys, "_cut").agg(F.sum("_c").alias("_c"), F.max("_total").alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_cut")
    by_cut = by_cut.withColumn("_end", F.sum("_c").over(along)).withColumn("_start", F.col("_end") - F.col("_c"))

    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), F.lit(float(p)).alias("p"))
        for name, p in probs.items() for side in ("lo", "hi")
    ])
    position = F.col("_w.p") * (F.col("_total") - 1)
    rank = F.when(F.col("_w.side") == "lo", F.floor(position)).otherwise(F.ceil(position))
    targets = (
        by_cut.withColumn("_w", F.explode(wanted)).withColumn("_rank", rank)
        .where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end")))
        .select(*keys, "_cut", "_w", (position - F.floor(position)).alias("_part"),
                (F.col("_rank") - F.col("_start")).alias("_offset"))
    )
    few = cut.select(*keys, "_cut", value, "_c").join(
        targets.select(*keys, "_cut").distinct(), [*keys, "_cut"], "left_semi"
    )
    inside = Window.partitionBy(*keys, "_cut").orderBy(value)
    few = few.withColumn("_to", F.sum("_c").over(inside)).withColumn("_from", F.col("_to") - F.col("_c"))
    found = few.join(targets, [*keys, "_cut"]).where(
        (F.col("_from") <= F.col("_offset")) & (F.col("_offset") < F.col("_to"))
    )
    pairs = found.groupBy(*keys, F.col("_w.name").alias("_name")).agg(
        F.max(F.when(F.col("_w.side") == "lo", F.col(value))).alias("_lo"),
        F.max(F.when(F.col("_w.side") == "hi", F.col(value))).alias("_hi"),
        F.max("_part").alias("_part"),
    ).withColumn("_v", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    return pairs.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in probs]
    )
