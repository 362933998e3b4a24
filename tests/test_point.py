import numpy as np
import pytest
from pyspark.sql import functions as F

from vanemesh.config import VariableConfig
from vanemesh.operators import point

S = ("A", "temp_out")


def times(df):
    return sorted((r.station_id, r.time) for r in df.collect())


def test_three_sigma_flags_only_the_spike(make_long):
    values = [10 + (i % 3 - 1) for i in range(30)] + [100]
    got = point.three_sigma(make_long({S: values})).collect()
    assert [r.value for r in got] == [100.0]
    assert got[0].expected == pytest.approx(np.mean(values))
    assert got[0].upper == pytest.approx(np.mean(values) + 3 * np.std(values))


@pytest.mark.parametrize("rule", [point.three_sigma, point.modified_zscore, point.raw_mad, point.iqr])
def test_constant_series_has_no_flags(make_long, rule):
    assert rule(make_long({S: [5.0] * 40})).count() == 0


def test_small_windows_cannot_flag(make_long):
    assert point.three_sigma(make_long({S: [1.0] * 9 + [1e6]})).count() == 0
    assert point.three_sigma(make_long({S: [1.0, 2.0]})).count() == 0


@pytest.mark.parametrize("rule", [point.three_sigma, point.modified_zscore])
def test_null_skips_or_silences(make_long, rule):
    long = make_long({S: [10 + i % 5 for i in range(30)] + [None, 500], ("B", "bar"): [1, 2, 3, 2] * 8 + [90]})
    assert {r.station_id for r in rule(long, on_null="skip").collect()} == {"A", "B"}
    assert {r.station_id for r in rule(long, on_null="propagate").collect()} == {"B"}


def test_nan_counts_as_null(spark, make_long):
    from vanemesh.sources.tables import long_form

    wide = make_long({S: [1, 2, 3]}).withColumn("temp_out", F.when(F.col("value") == 2, float("nan")).otherwise(
        F.col("value")))
    got = long_form(wide, ["temp_out", "not_there"])
    assert got.where("value IS NULL").count() == 1 and got.count() == 3


def test_median_rules_match_numpy(make_long):
    rng = np.random.default_rng(1)
    x = np.append(rng.normal(10, 1, 60), [25, -9])
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    long = make_long({S: x})
    z = 0.6745 * np.abs(x - med) / mad
    assert sorted(r.value for r in point.modified_zscore(long).collect()) == sorted(x[z > 3])
    assert sorted(r.value for r in point.raw_mad(long).collect()) == sorted(x[np.abs(x - med) / mad > 3.5])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    out = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    assert sorted(r.value for r in point.iqr(long).collect()) == sorted(x[out])


def test_row_order_does_not_matter(make_long):
    rng = np.random.default_rng(2)
    long = make_long({S: np.append(rng.normal(size=200), [9, -9])})
    mixed = long.repartition(7).orderBy(F.rand(3))
    for rule in (point.three_sigma, point.modified_zscore, point.sudden_change, point.lof):
        assert times(rule(long)) == times(rule(mixed))


def test_sudden_change_crosses_parts_and_gaps(make_long):
    values = [10, 10, None, 16, 16, 10.5, 10.5]
    for seconds in (600, 1800, 7 * 86400):
        got = point.sudden_change(make_long({S: values}), part_seconds=seconds).orderBy("time").collect()
        assert [(r.value, r.expected) for r in got] == [(16.0, 10.0), (10.5, 16.0)]


def test_range_and_sentinels(make_long):
    got = point.physical_range(make_long({S: [20, 41, -11, 99, -999, 30], ("A", "bar"): [1000, 949]}))
    assert sorted(r.value for r in got.collect()) == [-999.0, -11.0, 41.0, 99.0, 949.0]


def test_seasonal_residual_matches_numpy_and_parts(make_long):
    rng = np.random.default_rng(3)
    n, period = 130, 13
    x = 10 * np.sin(2 * np.pi * np.arange(n) / period) + 0.05 * np.arange(n) + rng.normal(0, 0.2, n)
    x[60] += 8
    long = make_long({S: x})
    whole = point.seasonal_residual(long)
    parts = point.seasonal_residual(long, part_rows=20, part_seconds=3600)
    assert [r.value for r in whole.collect()] == [x[60]]
    assert times(whole) == times(parts)
    trend = np.convolve(x, np.ones(13) / 13, "valid")
    rest = x[6:-6] - trend
    phase = (np.arange(6, n - 6)) % period
    resid = rest - np.array([rest[phase == p].mean() for p in phase])
    assert whole.first().score == pytest.approx(abs(resid[54]) / resid.std())


def lof_brute(x, k):
    n = len(x)
    d = np.abs(x[:, None] - x[None, :])
    near = []
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], x[j], j))
        near.append(order[:k])
    reach = np.array([d[i, near[i][-1]] for i in range(n)])
    density = np.array([1 / (np.mean([max(d[i, j], reach[j]) for j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean(density[near[i]]) / density[i] for i in range(n)])


def test_lof_matches_brute_force_with_duplicates(make_long):
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(0, 1, 70), rng.normal(8, 0.2, 30), [4.0, 15.0], np.zeros(25)]), 1)
    factor = lof_brute(x, 5)
    cut = np.quantile(-factor, 0.1)
    for rows in (50_000, 16):
        got = point.lof(make_long({S: x}), k=5, part_rows=rows).collect()
        assert sorted(r.value for r in got) == sorted(x[-factor < cut])
        by_value = dict(zip(x, factor))
        assert all(r.score == pytest.approx(by_value[r.value], rel=1e-6) for r in got)


def test_configured_methods_and_fallback(make_long):
    x = [10 + i % 4 for i in range(40)] + [60]
    long = make_long({("A", "temp_out"): x, ("A", "bar"): x})
    configs = (VariableConfig("temp_out", "", "", 3.0, "3sigma"), VariableConfig("bar", "", "", 3.0, "zscore"))
    got = {r.variable: r.method for r in point.detect_configured(long, configs).collect()}
    assert got == {"temp_out": "3sigma", "bar": "zscore"}
    assert times(point.detect(long, "no_such_method")) == times(point.three_sigma(long))


def test_first_records_and_registry(make_long):
    long = make_long({S: [10 + i % 4 for i in range(200)] + [500, 501, 502, 503, 504]})
    got = point.first_records(point.three_sigma(long), 3).orderBy("rank").collect()
    assert [(r["rank"], r.total, r.more) for r in got] == [(1, 5, 2), (2, 5, 2), (3, 5, 2)]
    point.register("none", lambda df: point.three_sigma(df).limit(0))
    try:
        assert point.detect(long, "none").count() == 0
    finally:
        point.METHODS.pop("none")


def test_sweep_keeps_stations_apart(make_long):
    from vanemesh.plans.queries_detect import swept

    quiet, wild = [10.0 + i % 2 for i in range(36)], [1000.0 * (-1) ** i for i in range(72)]
    long = make_long({("1", "x"): quiet + [*quiet[:-1], 30.0], ("3", "x"): wild})
    got = [(r.station_id, r.window_start.hour, r.flag_count, r.high_count, r.low_count) for r in swept(long).collect()]
    assert got == [("1", 6, 1, 1, 0)]
