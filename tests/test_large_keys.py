"""Ids of more digits than the small tables have."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from skyledger import registry


def test_split_accept_reject_with_seven_digits(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("event_id", F.col("event_id") + 1_234_000)
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sql = registry.oracle_sql()["split_accept_reject"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, registry.queries()["split_accept_reject"](spark, str(tmp_path)).select("event_id", "id", "reason").collect()))
    assert got == sorted(duckdb.sql(f"SELECT event_id, id, reason FROM ({sql})").fetchall()) and got
