"""Reading the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; Spark alone opens the path, so that any store it can read will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
