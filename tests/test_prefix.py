"""Running totals and exact ranks against plain Python, with ties, nulls, and many ranges."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from skyledger.plans import prefix


def test_running_totals_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 1, 5])) for k in rng.sample(range(10_000), 500)]
    got = prefix.running_total(spark.createDataFrame(rows, "at long, v long").repartition(7), ["at"], "v", "total").collect()
    want = dict(zip(sorted(k for k, _ in rows), itertools.accumulate(v or 0 for _, v in sorted(rows, key=lambda r: r[0]))))
    assert {r["at"]: r["total"] for r in got} == want
    assert prefix.running_total(spark.createDataFrame([], "at long, v long"), ["at"], "v", "total").count() == 0


def test_ranks_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.0, rng.random()])) for _ in range(400)] + [("c", 7.0)]
    v = prefix.value_counts(spark.createDataFrame(rows, "g string, x double"), "g", "x")
    for share in (0.0, 0.5, 0.9, 1.0):
        picked = v.groupBy("g").agg(F.max(F.when(prefix.at_rank(F.floor((F.col("of") - 1) * share)), F.col("x"))).alias("x"))
        for r in picked.collect():
            own = sorted(x for g, x in rows if g == r["g"] and x is not None)
            assert r["x"] == own[int((len(own) - 1) * share)]
