"""Session settings and the shared folder that staged tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skyledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # pairs and candidates make much work of few bytes, so small partitions are kept apart
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see.

    It is what the cluster names in ``spark.checkpoint.dir`` (or what the program has set with
    ``setCheckpointDir``). Only a local master, where all tasks share one disk, gets a folder of our own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not (context.master.startswith("local[") or context.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="skyledger-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most while a job runs: both the JVM and a Python worker hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage_table(df: DataFrame, name: str, batch_rows: int = 1_000) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor and keeps a costly step from running twice.
    Python steps of ``df`` get batches of ``batch_rows`` rows, as rows with whole texts can be large.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
