import os

# Threads of the linear algebra library can hang in a driver process that has started a JVM.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from datetime import datetime, timedelta  # noqa: E402

import pytest  # noqa: E402

from vanemesh import session  # noqa: E402

START = datetime(2025, 1, 1)
LONG = "station_id string, variable string, time timestamp_ntz, value double"


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_long(spark):
    """Long rows from lists of values per (station, variable), one reading per step."""

    def make(series: dict, step=timedelta(minutes=10), start=START):
        rows = [
            (s, v, start + i * step, None if x is None else float(x))
            for (s, v), values in series.items() for i, x in enumerate(values)
        ]
        return spark.createDataFrame(rows, LONG)

    return make
