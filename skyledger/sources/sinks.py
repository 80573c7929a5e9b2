"""Sinks: JSON lines with a row count, and an append-only table whose columns may change between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write rows as JSON lines, fields in order of name and nulls kept, and return how many; counted while they are written."""
    seen = Observation()
    counted = df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return int(seen.get["rows"])


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows of any columns: each list of columns has a folder of its own, so a new one leaves older rows as they are."""
    header = ",".join(df.columns)
    df.withColumn("header", F.lit(header)).write.mode("append").partitionBy("header").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were appended, with all columns that any of them has, and ``header``: the columns of its run."""
    return spark.read.option("mergeSchema", "true").parquet(path)
