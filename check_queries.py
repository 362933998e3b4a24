"""Run the named queries next to their SQL in DuckDB: ``python check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from vanemesh import session
from vanemesh.plans import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, sf):
    started = time.time()
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in SQL:
        return f"rows-only {len(got)} rows", took, bool(got)
    started = time.time()
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    sql_took = time.time() - started
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", took, False
    kinds = dict(df.dtypes)
    other = {d[0]: str(d[1]).lower() for d in cur.description}
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "timestamp_ntz": "timestamp",
            "boolean": "boolean", "date": "date"}
    odd = {c: (kinds[c], other[c]) for c in columns if kinds[c] in same and same[kinds[c]] != other[c]}
    if got == want:
        return f"{'TYPES ' + str(odd) if odd else 'ok'} {len(got)} rows (sql {sql_took:.1f}s)", took, not odd
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"DIFFERENT {len(got)} vs {len(want)} rows, first {bad[:2]} columns {sorted(columns)} {odd}", took, False


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session.build(f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8,
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    failed = []
    for name in names:
        try:
            text, took, ok = compare(spark, con, name, sf)
        except Exception as e:  # report and go on
            text, took, ok = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, False
        spark.catalog.clearCache()
        print(f"{'  ' if ok else '! '}{name}: {took:.1f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
