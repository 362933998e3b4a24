"""Hot-key and part-wise building blocks against their plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanemesh.operators import scale
from vanemesh.operators.quantiles import exact_quantiles


@pytest.fixture
def skewed(spark):
    """Key 0 holds most rows."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("t"),
        ((F.col("id") * 7919) % 1009 / 10.0).alias("value"))


def test_attach_salted_equals_broadcast(skewed):
    stats = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    plain = scale.attach(skewed, stats, ["k"], "n", ["t"])
    salted = scale.attach(skewed, stats, ["k"], "n", ["t"], rows=50, small_rows=0)
    assert salted.count() == 6000
    assert salted.exceptAll(plain.select(salted.columns)).count() == 0


def test_attach_spreads_the_hot_key(skewed, spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        stats = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        salted = scale.attach(skewed, stats, ["k"], "n", ["t"], rows=50, small_rows=0)
        parts = salted.where("k = 0").groupBy(F.spark_partition_id()).count().count()
        assert parts > 1
    finally:
        for key in small:
            spark.conf.unset(key)


@pytest.mark.parametrize("direct", [1_000_000, 100])
def test_quantiles_equal_numpy(skewed, direct):
    probs = {"a": 0.05, "b": 0.5, "c": 0.973}
    got = {r.k: r for r in exact_quantiles(skewed, ["k"], "value", probs, direct_rows=direct).collect()}
    data = skewed.toPandas().groupby("k")["value"]
    assert set(got) == set(data.groups)
    for k, values in data:
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_weighted_quantiles_equal_expanded(skewed):
    counts = skewed.groupBy("k", "value").agg(F.count(F.lit(1)).alias("c"))
    for direct in (1_000_000, 10):
        got = {r.k: r.q for r in exact_quantiles(counts, ["k"], "value", {"q": 0.3}, "c", direct_rows=direct).collect()}
        want = {r.k: r.q for r in exact_quantiles(skewed, ["k"], "value", {"q": 0.3}).collect()}
        assert got == pytest.approx(want)


def test_index_by_parts_equals_row_number(skewed):
    part = F.floor(F.col("t") / 100).cast("long")
    got = scale.with_index(skewed, ["k"], ["t"], part)
    want = skewed.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1)
    assert got.join(want, ["k", "t"]).where("idx <> want").count() == 0
    assert got.count() == 6000


def test_halo_gives_each_part_its_neighbourhood(spark):
    rows = spark.range(100).select(F.col("id").alias("idx"))
    parts = scale.with_halo(rows, "idx", 10, 3, 2)
    assert parts.where("home").count() == 100
    inner = parts.where("part = 4").agg(F.min("idx"), F.max("idx"), F.count("*")).first()
    assert tuple(inner) == (37, 51, 15)
