"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import stage_table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, keep: Column, with_centre: bool) -> DataFrame:
    """Link what ``keep`` leaves of each node's neighbours to the least node of its neighbourhood.

    The least node is an aggregate with map-side combine and joined back, so that no neighbourhood is ever
    gathered into one row or task; a hub with many links is a skewed join side, which adaptive execution splits.
    """
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = links.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_centre:
        near = near.union(least.select("u", F.col("m").alias("v")))
    return near.where("u <> v").distinct()


#: Links that a task looks at together before rounds begin.
LOCAL_LINKS = 1 << 18


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links that are not the least of their component among these links, and that least node for each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        for to in (label[a], label[b], a, b):
            np.minimum.at(label, to, least)
        while (label[label] != label).any():
            label = label[label]
        if (label[a] == label[b]).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def locally_contracted(links: DataFrame) -> DataFrame:
    """Links ``u, v`` between whole numbers with the same nodes and components, of which no task leaves more than it has nodes: crowded groups
    have far more links than nodes, and star rounds would carry all of them."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        stars = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in local_stars(*map(np.concatenate, zip(*kept)))], schema=schema)
        for batch in batches:
            if batch.num_rows:
                kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in kept) >= LOCAL_LINKS:
                yield stars()
                kept.clear()
        if kept:
            yield stars()

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 64, crowded: bool = False) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its least node.

    Rounds grow with the logarithm of the longest path. Each round is written to the shared folder, and only a
    row count and a checksum of it reach the driver. Self-links and nulls in either column carry no link and are
    left out; repeated edges count once. An empty input gives an empty result. ``crowded`` groups of whole numbers, with far
    more links than nodes, are contracted within tasks first.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    if crowded:
        pairs = locally_contracted(pairs)
    pairs = stage_table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        large = _star(_both_ways(pairs), F.col("v") > F.col("u"), with_centre=False)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, F.lit(True), with_centre=True)
        pairs = stage_table(small, "edges")
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
