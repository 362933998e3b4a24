"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the threads (default 8).
Every query runs over its whole tables into the noop sink, once after a short warm-up of the session; cached
results are dropped before each run.
"""

from __future__ import annotations

import json
import os
import re
import time

from vanemesh import session
from vanemesh.plans import QUERIES

HEADLINES = (
    "window_scan", "latest_per_station", "hourly_rollup", "profile_station", "profile_global", "point_3sigma",
    "point_zscore", "point_iqr", "point_sudden_change", "seasonal_residual", "lof", "arma_residuals",
    "isolation_forest", "health_variables", "health_station", "neighbors", "spatial_snapshot", "interpolate_gaps",
    "trend_verify", "pair_correlation", "acf_window", "matrix_profile", "profile_events", "geojson_observations",
    "ingest_dedupe", "overall_status",
)


def timed(spark, name: str, sf: str) -> float:
    spark.catalog.clearCache()
    started = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",") if n]
    spark = session.build(f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("station_summary", "arma_residuals", "point_zscore"):  # JVM and Python workers warm
        timed(spark, name, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf)
    seconds = {name: round(timed(spark, name, sf), 3) for name in names}
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    session.drop_run_folders(spark)
    spark.stop()


if __name__ == "__main__":
    main()
