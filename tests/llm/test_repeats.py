"""Repeated candidates of a nearest-neighbour search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import nearest


def test_repeated_rows_do_not_crowd_out_neighbours(spark):
    vectors = np.random.default_rng(1).standard_normal((40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors) for _ in range(12)]
    rows += [(1, (vectors[0] + 0.001 * k).tolist()) for k in range(1, 12)]  # one id with several near vectors
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    distance = np.sqrt(((vectors - vectors[0]) ** 2).sum(1))
    distance[:2] = np.inf
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [1, *np.argsort(distance)[:9].tolist()]


def brute(vectors, query, k):
    distance = nearest.distances(vectors, vectors[query])
    distance[query] = np.inf
    return np.argsort(distance, kind="stable")[:k].tolist()


@pytest.mark.parametrize("size", [1e-300, 1e-200, 1.0, 1e100, 1e200, 1e307])
def test_values_of_any_size(spark, size):
    vectors = np.random.default_rng(2).standard_normal((50, 6)) * size
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = sorted(nearest.nearest(frame, F.col("vec_id") == 0, 5).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in found] == brute(vectors, 0, 5)
    assert all(np.isfinite(r["score"]) and r["score"] > 0 for r in found)


def test_sizes_far_apart_in_one_block():
    vectors = np.vstack([np.eye(4) * s for s in (1e-200, 1.0, 1e200)])
    found = nearest.search_block(vectors, np.arange(12), vectors[:1], np.arange(1), 4)
    assert [v for _, v, _ in found][:3] == [1, 2, 3]


@pytest.mark.parametrize("n", [500, 5_000])
def test_recall_at_two_sizes(n):
    rng = np.random.default_rng(n)
    vectors = rng.standard_normal((n, 24)) + 3 * rng.standard_normal((10, 24))[rng.integers(0, 10, n)]
    queries = np.arange(0, n, n // 25)
    found = nearest.search_block(vectors, np.arange(n), vectors[queries], queries, 10)
    hits = sum(len({v for q2, v, _ in found if q2 == q} & set(brute(vectors, q, 10))) for q in queries.tolist())
    assert hits >= 0.9 * 10 * len(queries)
