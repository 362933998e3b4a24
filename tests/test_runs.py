from datetime import timedelta
from itertools import groupby

import numpy as np
import pytest

from vanemesh.operators import runs

STEP = timedelta(minutes=10)


def brute(values, start, min_rows, min_zeros):
    found = []
    known = [(v, start + i * STEP) for i, v in enumerate(values) if v is not None]
    for v, group in groupby(known, key=lambda r: r[0]):
        group = list(group)
        if len(group) >= (min_zeros if v == 0 else min_rows):
            found.append(("zero" if v == 0 else "constant", v, group[0][1], group[-1][1], len(group)))
    return sorted(found, key=lambda r: r[2])


@pytest.mark.parametrize("part_seconds", [None, 600, 3600, 86400])
def test_runs_over_parts(make_long, part_seconds):
    rng = np.random.default_rng(1)
    values = [0.0] * 40 + [float(v) for v in rng.integers(0, 3, 150)] + [5.0] * 30 + [0.0, None, 0.0, 0.0] + [-0.0] * 2 + [7.0]
    series = {("A", "v"): values, ("B", "v"): [1.0] * 5, ("C", "v"): [None] * 9, ("D", "v"): [2.0] * 70}
    long = make_long(series)
    start = long.agg({"time": "min"}).first()[0]
    got = runs.constant_runs(long, 6, 3, part_seconds=part_seconds).collect()
    for (station, _), given in series.items():
        mine = sorted(((r.kind, r.value, r.start_time, r.end_time, r.run_rows) for r in got if r.station_id == station), key=lambda r: r[2])
        assert mine == brute(given, start, 6, 3)


def test_runs_of_nothing(make_long):
    assert runs.constant_runs(make_long({("A", "v"): [1.0, 1.0]}).where("false")).count() == 0
