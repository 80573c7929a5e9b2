"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are projected on random lines; for each line a block keeps its vectors in sorted order. A query's window on
every line grows about the query's own projection (virtual rehashing: no bucket has a fixed border), and a vector that
is in the window on enough lines is verified by its distance. The search of a block ends when the k-th verified
distance is within the radius that the windows stand for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 48
#: Half the window's width per unit of radius, and the share of lines on which a vector must collide. A vector at the
#: radius is in a window with probability 2 * Phi(1) - 1 = 0.68, so it passes 0.55 of 48 lines 19 times in 20.
HALF_WIDTH = 1.0
COLLISIONS = 0.55
EXPANSION = 1.15
#: The first radius, as a share of the distance to the nearest of a few vectors.
FIRST = 0.7
#: Components of a block of vectors and of one of queries: 20 000 and 2 000 of 64, and fewer longer ones.
BLOCK_VALUES = 20_000 * 64
QUERY_VALUES = 2_000 * 64
#: Queries whose counts are held at a time.
CHUNK_QUERIES = 128
SEED = 20_240_607


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, not zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fine = vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, in a scale in which no square overflows or vanishes if the plain formula's would."""
    with np.errstate(over="ignore", under="ignore"):
        apart = vectors - query
        most = np.abs(apart).max(initial=0.0)
        if most == 0 or 1e-140 < most < 1e140:
            return np.sqrt((apart**2).sum(1))
        scale = 2.0 ** min(1023, np.frexp(max(np.abs(vectors).max(), np.abs(query).max()) if np.isinf(most) else most)[1])
        return np.sqrt(((vectors / scale - query / scale) ** 2).sum(1)) * scale


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``(query, vector, distance)``: each query's ``k`` nearest of the block that were found, itself left out."""
    # searched at a scale near 1, so that windows cover every line after a bounded number of rounds
    original, asked = vectors, queries
    scale = 2.0 ** min(1023, np.frexp(max(np.abs(vectors).max(initial=0.0), np.abs(queries).max(initial=0.0)))[1])
    vectors, queries = vectors / scale, queries / scale
    lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], LINES))
    projected = vectors @ lines
    order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
    ranked = np.take_along_axis(np.ascontiguousarray(projected.T), order, 1)
    out = []
    for at in range(0, len(queries), CHUNK_QUERIES):
        part = slice(at, at + CHUNK_QUERIES)
        for i, close in enumerate(_search_chunk(vectors, ids, queries[part], query_ids[part], queries[part] @ lines, order, ranked, k)):
            exact = distances(original[close], asked[at + i])
            best = np.lexsort((ids[close], exact))
            found = ids[close][best]
            first = np.sort(np.unique(found, return_index=True)[1])[:k]  # an id with several vectors counts by its nearest
            out += [(int(query_ids[at + i]), int(found[b]), float(exact[best[b]])) for b in first]
    return out


def _search_chunk(
    vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, centres: np.ndarray, order: np.ndarray, ranked: np.ndarray, k: int
) -> list[np.ndarray]:
    """For each query the places of the verified vectors."""
    n, m = len(vectors), len(queries)
    need = int(np.ceil(COLLISIONS * LINES))
    itself = [ids == q for q in query_ids]
    different = len(np.unique(ids))  # an id can have several vectors
    wanted = np.array([min(k, different - bool(own.any())) for own in itself])
    # windows begin well inside the distance to the nearest of a few vectors
    few = vectors[:: max(1, n // 256)]
    radius = np.sqrt(np.maximum((few**2).sum(1) - 2 * queries @ few.T + (queries**2).sum(1)[:, None], 0)).min(1)
    radius = np.maximum(radius * FIRST, 1e-6)
    counts = np.zeros((m, n), np.int16)
    distance = np.full((m, n), np.inf)
    verified = np.zeros((m, n), bool)
    low = high = np.stack([np.searchsorted(ranked[j], centres[:, j]) for j in range(LINES)])
    live = np.flatnonzero(wanted > 0)
    while len(live):
        half = HALF_WIDTH * radius
        new_low = np.stack([np.searchsorted(ranked[j], centres[:, j] - half, "left") for j in range(LINES)])
        new_high = np.stack([np.searchsorted(ranked[j], centres[:, j] + half, "right") for j in range(LINES)])
        rest = []
        for i in live:
            bounds = zip(order, new_low[:, i].tolist(), low[:, i].tolist(), high[:, i].tolist(), new_high[:, i].tolist())
            fresh = np.concatenate([x for line, a, b, c, d in bounds for x in (line[a:b], line[c:d])])
            counts[i] += np.bincount(fresh, minlength=n).astype(np.int16)
            new = np.flatnonzero((counts[i] >= need) & ~verified[i])
            verified[i, new] = True
            distance[i, new] = np.sqrt(((vectors[new] - queries[i]) ** 2).sum(1))
            distance[i, itself[i]] = np.inf
            close = distance[i] <= radius[i]
            within = int(close.sum()) if different == n else len(np.unique(ids[close]))
            if within < wanted[i] and not verified[i].all():
                rest.append(i)
        low, high, live = new_low, new_high, np.array(rest, np.int64)
        radius = radius * EXPANSION
    return [np.flatnonzero(np.isfinite(distance[i])) for i in range(m)]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found of each query, by Euclidean distance.

    Vectors and queries are dealt into blocks by a hash of the id, and every pair of blocks is searched by one task,
    so a task's memory is bounded whatever the number of either; the best of each block meet in a top-k by query.

    Null, zero and non-finite vectors, and null ids, take no part; only vectors of the query's own length are its
    candidates. Ties go to the smaller id, and copies of one vector are all verified. A query's own id is never its
    candidate, in any repeated row; repeated candidate rows count once, and an id with several vectors by its nearest. A query with several vectors asks
    by each of them, and a candidate counts by its least distance from any.
    With at most ``k`` candidates all are returned. Values may be of any finite size. Other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.max("q").alias("q"))
    values, asked_values = rows.agg(F.sum(F.size("v")), F.sum(F.when(F.col("q"), F.size("v")))).first()
    blocks, query_blocks = max(1, -(-(values or 0) // BLOCK_VALUES)), max(1, -(-(asked_values or 0) // QUERY_VALUES))
    part = lambda of: F.pmod(F.xxhash64("id"), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select("id", "v", F.size("v").alias("dims"), part(blocks).cast("int").alias("block")).withColumn("query_block", each(query_blocks))
    right = rows.where("q").select("id", "v", F.size("v").alias("dims"), part(query_blocks).cast("int").alias("query_block")).withColumn("block", each(blocks))

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(block) and len(asked):
            found = search_block(
                np.array(block["v"].tolist(), float), block["id"].to_numpy(), np.array(asked["v"].tolist(), float), asked["id"].to_numpy(), k
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["dims", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
