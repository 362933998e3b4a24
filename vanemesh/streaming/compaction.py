"""Compaction of the stored tables: the small folders of many batches become one set of files a day.

A manifest, one JSON file a version, says for each table and day which compacted folder counts and up to which batch of each run it
holds the rows. Readers take the newest manifest: the compacted folder it names, and the batch folders that it does not cover. So the
creation of the next manifest, under a name that appears whole by a rename, is the only switch.

1. ``clean`` deletes what the newest manifest makes needless: covered batch folders, and compacted folders that it does not name.
2. New compacted folders are written next to the old ones. A crash here leaves folders that no manifest names.
3. The next manifest is renamed into place. A crash after that leaves covered folders, which readers pass over.

Files of the step before stay until the next compaction, for readers that have just opened them. Only batches with a row in the log
are merged, as the log is the last that a batch writes. A batch that is repeated later replaces its own folder, which stays covered.
Folders that are listed: a few for each day, however many batches there were; the manifest has an entry for each day and run.
One compaction runs at a time; ingest may go on meanwhile.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one compacted file, about.
FILE_ROWS = 2_000_000
# The day of tables without days.
ALL = ""


class Files:
    """The few operations on a shared folder that compaction needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def glob(self, pattern: str) -> list[str]:
        return [s.getPath().toString() for s in self.fs.globStatus(self.path(pattern)) or []]

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """The whole file at once, or nothing; an existing one is an error."""
        hidden = re.sub(r"([^/]+)$", r"_\1-" + uuid.uuid4().hex, path)
        stream = self.fs.create(self.path(hidden), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.path(path)) or not self.fs.rename(self.path(hidden), self.path(path)):
            self.fs.delete(self.path(hidden), False)
            raise FileExistsError(path)


@dataclass
class Manifest:
    """``folders``: table and day to the version of the compacted folder. ``covered``: table and day to the last batch of each run."""

    version: int = 0
    folders: dict[tuple[str, str], int] = field(default_factory=dict)
    covered: dict[tuple[str, str], dict[str, int]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "parts": [
            {"table": t, "day": d, "folder": v, "covered": self.covered[t, d]} for (t, d), v in sorted(self.folders.items())]})

    @classmethod
    def parsed(cls, text: str) -> Manifest:
        data = json.loads(text)
        return cls(data["version"], {(p["table"], p["day"]): p["folder"] for p in data["parts"]},
                   {(p["table"], p["day"]): p["covered"] for p in data["parts"]})


def newest(files: Files, folder: str) -> Manifest:
    found = sorted(files.glob(f"{folder}/manifest/v*.json"))
    return Manifest.parsed(files.read(found[-1])) if found else Manifest()


def compacted_folder(folder: str, table: str, day: str, version: int) -> str:
    return f"{folder}/compacted/{table}/version={version}" + (f"/obs_date={day}" if day else "")


def batch_folders(files: Files, folder: str, table: str, days: bool) -> dict[str, list[tuple[str, int, str]]]:
    """The folders of single batches: day to run, batch and path."""
    found = defaultdict(list)
    for path in files.glob(f"{folder}/{table}/" + ("obs_date=*/" if days else "") + "run=*/batch_id=*"):
        parts = dict(re.findall(r"/(obs_date|run|batch_id)=([^/]*)", path))
        found[parts.get("obs_date", ALL)].append((parts["run"], int(parts["batch_id"]), path))
    return found


def finished(files: Files, folder: str, last_table: str) -> dict[str, int]:
    """The last batch of each run that has written ``last_table``, which every batch writes at its end."""
    done = dict(newest(files, folder).covered.get((last_table, ALL), {}))
    for path in files.glob(f"{folder}/{last_table}/run=*/batch_id=*/_SUCCESS"):
        run, batch_id = re.search(r"/run=([^/]*)/batch_id=(\d+)/", path).groups()
        done[run] = max(done.get(run, -1), int(batch_id))
    return done


def rows(spark: SparkSession, folder: str, table: str, schema, days: bool) -> DataFrame:
    """All rows of a stored table, compacted or not, with their run and batch_id. ``schema`` has them and, with ``days``, obs_date."""
    manifest = newest(Files(spark, folder), folder)
    loose = spark.read.schema(schema).parquet(f"{folder}/{table}")
    parts = {day: v for (t, day), v in manifest.folders.items() if t == table}
    if not parts:
        return loose
    covered = [(day or None, run, last) for (t, day), upto in manifest.covered.items() if t == table for run, last in upto.items()]
    known = spark.createDataFrame(covered, "_day string, _run string, _last int")  # an entry a day and run; nothing grows with the rows
    same = (F.col("run") == F.col("_run")) & (F.col("batch_id") <= F.col("_last"))
    if days:
        same = same & (F.col("obs_date") == F.col("_day").cast("date"))
    open_ = loose.join(F.broadcast(known), same, "left_anti")
    paths = [compacted_folder(folder, table, day, v) for day, v in parts.items()]
    versions = sorted(set(parts.values()))
    merged = None
    for version in versions:  # obs_date is told by the path below its version
        own = [p for p in paths if f"/version={version}/" in p + "/"]
        reader = spark.read.schema(schema).option("basePath", f"{folder}/compacted/{table}/version={version}")
        one = reader.parquet(*own)
        merged = one if merged is None else merged.unionByName(one)
    return open_.unionByName(merged.select(*open_.columns))


def clean(spark: SparkSession, folder: str, tables: dict[str, bool]) -> int:
    """Delete what the newest manifest makes needless; how many folders went. ``tables``: name to whether it has days."""
    files = Files(spark, folder)
    manifest, gone = newest(files, folder), 0
    for table, days in tables.items():
        for day, batches in batch_folders(files, folder, table, days).items():
            upto = manifest.covered.get((table, day), {})
            for run, batch_id, path in batches:
                if batch_id <= upto.get(run, -1):
                    files.delete(path)
                    gone += 1
        named = {compacted_folder("", table, day, v) for (t, day), v in manifest.folders.items() if t == table}
        depth = "version=*/obs_date=*" if days else "version=*"
        for path in files.glob(f"{folder}/compacted/{table}/{depth}"):
            if not any(path.endswith(n) for n in named):
                files.delete(path)
                gone += 1
        for path in files.glob(f"{folder}/compacted/{table}/version=*") if days else []:
            if not files.glob(f"{path}/obs_date=*"):
                files.delete(path)
    for path in sorted(files.glob(f"{folder}/manifest/v*.json"))[:-1]:
        files.delete(path)
    return gone


def compact(spark: SparkSession, folder: str, tables: dict[str, bool], done: dict[str, int], schemas: dict, merge: dict | None = None,
            least: int = 2, file_rows: int = FILE_ROWS) -> Manifest:
    """Merge the batch folders of every table and day that has ``least`` of them or more, up to the batches ``done`` of each run.

    ``merge`` may name a function for a table that makes fewer rows of its rows with the same meaning.
    """
    clean(spark, folder, tables)
    files = Files(spark, folder)
    manifest = newest(files, folder)
    following = Manifest(manifest.version + 1, dict(manifest.folders), {k: dict(v) for k, v in manifest.covered.items()})
    changed = False
    for table, days in tables.items():
        ready = {}
        for day, batches in batch_folders(files, folder, table, days).items():
            upto = manifest.covered.get((table, day), {})
            new = [(r, b) for r, b, _ in batches if upto.get(r, -1) < b <= done.get(r, -1)]
            if len(new) >= least:
                ready[day] = new
        if not ready:
            continue
        changed = True
        all_rows = rows(spark, folder, table, schemas[table], days)
        upto = spark.createDataFrame(list(done.items()), "_run string, _done int")  # a row a run
        stored = all_rows.join(F.broadcast(upto), (F.col("run") == F.col("_run")) & (F.col("batch_id") <= F.col("_done")), "left_semi")
        target = f"{folder}/compacted/{table}/version={following.version}"
        if days:
            stored = stored.where(F.col("obs_date").cast("string").isin(sorted(ready)))
            n = stored.groupBy("obs_date").agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).cast("int").alias("_files"))
            spread = stored.join(F.broadcast(n), "obs_date").withColumn("_file", F.pmod(F.xxhash64("time", "station_id"), F.col("_files")))
            by_file = spread.repartition("obs_date", "_file").drop("_files", "_file")
            by_file.write.mode("overwrite").partitionBy("obs_date").parquet(target)
        else:
            stored = (merge or {}).get(table, lambda x: x)(stored)
            stored.repartition(max(1, -(-stored.count() // file_rows))).write.mode("overwrite").parquet(target)
        for day, new in ready.items():
            following.folders[table, day] = following.version
            own = following.covered.setdefault((table, day), {})
            for run, batch_id in new:
                own[run] = max(own.get(run, -1), done[run], batch_id)
    if changed:
        files.create(f"{folder}/manifest/v{following.version:012d}.json", following.text())
    return following if changed else manifest
