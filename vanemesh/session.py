"""Session settings and the shared folder for checkpoints and run output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName("vanemesh")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on local masters without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vanemesh-"))
    return sc.getCheckpointDir().rstrip("/")


def drop_run_folders(spark: SparkSession) -> None:
    """Delete what this application has written between its steps. Nothing that reads it may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/vanemesh-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one output or intermediate table, under one folder per application."""
    return f"{shared_folder(spark)}/vanemesh-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
