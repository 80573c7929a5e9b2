"""Hard negatives by segment summary filtering.

A vector is cut into segments, and of each the mean and the deviation are stored. Over a segment of length ``n``, the
inner product of two vectors is ``n`` times the product of their means, plus or minus at most ``n`` times the product of
their deviations, so summaries alone bound a score from both sides. Few long segments drop what is clearly out of
reach; what is left is bounded by more and shorter ones, and only what passes the last level is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import stage_table

#: Numbers of segments, from level to level.
LEVELS = (1, 4, 16, 32)
#: Components of a block of candidates or anchors: 32 MB as whole numbers.
BLOCK_VALUES = 1 << 22
#: Anchors that are compared with a block at a time.
CHUNK_ANCHORS = 32
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """Components as ``floor(scale * x)``; what no long can hold becomes the nearest long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


class Summaries:
    """Of each row and segment the mean and the deviation, both times the root of the segment's length."""

    def __init__(self, rows: np.ndarray):
        self.norm = np.sqrt((rows.astype(float) ** 2).sum(1))
        self.levels = []
        for segments in sorted({min(s, rows.shape[1]) for s in LEVELS} - {0}):
            starts = np.linspace(0, rows.shape[1], segments + 1).astype(int)
            length = np.diff(starts)
            floats = rows.astype(float)
            mean = np.add.reduceat(floats, starts[:-1], 1) / np.sqrt(length)
            squares = np.add.reduceat(floats**2, starts[:-1], 1)
            self.levels.append((mean, np.sqrt(np.maximum(squares - mean**2, 0.0))))


def bounds(level: int, left: Summaries, i: np.ndarray, right: Summaries, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No score of rows ``i`` with rows ``j`` is lower or higher; widened by what the floats may be off."""
    (mean_i, dev_i), (mean_j, dev_j) = left.levels[level], right.levels[level]
    centre, spread = mean_i[i] @ mean_j[j].T, dev_i[i] @ dev_j[j].T
    spread += 1e-9 * left.norm[i][:, None] * right.norm[j] + 1e-6
    return np.clip(centre - spread, LONG_MIN, LONG_MAX), np.clip(centre + spread, LONG_MIN, LONG_MAX)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as Python's integers where they could leave the exact range of floats.

    One that no long can hold becomes the nearest long.
    """
    most = [int(x.max(initial=0)) if x.size else 0 for x in (np.abs(left.astype(float)), np.abs(right.astype(float)))]
    if most[0] * most[1] * left.shape[1] < 1 << 52:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return np.minimum(np.maximum(left.astype(object) @ right.astype(object).T, LONG_MIN), LONG_MAX)


def survivors(
    left: Summaries, i: np.ndarray, right: Summaries, j: np.ndarray, allowed: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> np.ndarray:
    """The pairs of ``allowed`` (rows ``i`` by rows ``j``) that ``keep(live, low, high)`` leaves on every level."""
    live = allowed.copy()
    for level in range(len(left.levels)):
        some = np.flatnonzero(live.any(0))
        if not len(some):
            break
        low, high = bounds(level, left, i, right, j[some])
        live[:, some] = keep(live[:, some], low, high)
    return live


def kth_largest(values: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest of the ``known`` values, or minus infinity."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(known, values, -np.inf), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _scores_of(live: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``live`` its partners and their exact scores."""
    some = np.flatnonzero(live.any(0))
    scores = exact_scores(left, right[some])
    for at, row in enumerate(live[:, some]):
        yield at, some[row], scores[at, row]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda p: (-scores[p], ids[p])), int)
    return order[:k]


class Block:
    """Candidates or anchors of one length, with their summaries."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.rows, self.ids, self.labels = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        vectors = table.column("v").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.v = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.int64)
        self.copies = table.column("copies").to_numpy()
        self.summaries = Summaries(self.v)
        self.positives = table.column("positives").to_pylist() if "positives" in table.column_names else None


def nearest_of_label(anchors: Block, block: Block, k: int) -> list[tuple[int, int, int, int]]:
    """``(row, id, score, copies)``: for each anchor its ``k`` highest scored others of the block with its label."""
    out = []

    def keep(live: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return live & (high >= kth_largest(low, live, k)[:, None])

    for label in np.unique(anchors.labels):
        of_label, near = np.flatnonzero(anchors.labels == label), np.flatnonzero(block.labels == label)
        for at in range(0, len(of_label), CHUNK_ANCHORS):
            i = of_label[at : at + CHUNK_ANCHORS]
            itself = anchors.rows[i][:, None] == block.rows[near]
            live = survivors(anchors.summaries, i, block.summaries, near, ~itself | (block.copies[near] > 1), keep)
            for a, js, scores in _scores_of(live, anchors.v[i], block.v[near]):
                for p in _first(scores, block.ids[near][js], k):
                    own = bool(itself[a, js[p]])
                    out.append((int(anchors.rows[i[a]]), int(block.ids[near[js[p]]]), int(scores[p]), int(block.copies[near[js[p]]]) - own))
    return out


def negatives_in_bands(anchors: Block, block: Block, k: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """``(row, positive, id, score, copies)``: for each anchor and score of a positive, the ``k`` highest scored rows of
    other labels between that score and ``percent`` of it."""
    out = []
    for at in range(0, len(anchors.rows), CHUNK_ANCHORS):
        i = np.arange(at, min(at + CHUNK_ANCHORS, len(anchors.rows)))
        tops = sorted({(a, p["score"]) for a in i for p in anchors.positives[a] if p["score"] >= 0})
        if not tops:
            continue
        of, top = np.array([a - at for a, _ in tops]), np.array([float(t) for _, t in tops])
        bottom = top * percent / 100

        def keep(live: np.ndarray, low: np.ndarray, high: np.ndarray, of=of, top=top, bottom=bottom) -> np.ndarray:
            low, high = low[of], high[of]
            inside = live[of] & (low >= bottom[:, None] * (1 + 1e-9)) & (high <= top[:, None])
            least = np.maximum(kth_largest(low, inside, k), bottom * (1 - 1e-9))[:, None]
            fits = live[of] & (high >= least) & (low <= top[:, None])
            left = np.zeros_like(live)
            np.logical_or.at(left, of, fits)
            return left

        live = survivors(anchors.summaries, i, block.summaries, np.arange(len(block.rows)), anchors.labels[i][:, None] != block.labels, keep)
        for a, js, scores in _scores_of(live, anchors.v[i], block.v):
            for score in sorted({p["score"] for p in anchors.positives[i[a]]}):
                fits = np.flatnonzero((scores <= score) & (100 * scores >= percent * score)) if scores.dtype != object else np.array(
                    [p for p, s in enumerate(scores) if s <= score and 100 * s >= percent * score], int
                )
                for p in fits[_first(scores[fits], block.ids[js[fits]], k)]:
                    out.append((int(anchors.rows[i[a]]), score, int(block.ids[js[p]]), int(scores[p]), int(block.copies[js[p]])))
    return out


def _against_blocks(rows: DataFrame, anchors: DataFrame, of_pair: Callable[[Block, Block], list[tuple]], schema: str) -> DataFrame:
    """``of_pair`` over every block of anchors and every block of ``rows`` of the same vector length.

    Rows go to blocks by a hash, and the numbers of blocks follow the numbers of components, so a task's memory is
    bounded whatever the label or the length of vectors.
    """
    size = lambda of: of.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    (n, values), (_, anchor_values) = size(rows), size(anchors)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-values // BLOCK_VALUES), min(tasks, n // 1_000))
    anchor_blocks = max(1, -(-anchor_values // BLOCK_VALUES))
    part = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.withColumn("dims", F.size("v")).withColumn("block", part(blocks)).withColumn("anchor_block", each(anchor_blocks))
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns apart from those of rows
    right = own.withColumn("dims", F.size("v")).withColumn("anchor_block", part(anchor_blocks)).withColumn("block", each(blocks))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        found = of_pair(Block(asked), Block(block)) if block.num_rows and asked.num_rows else []
        columns = list(zip(*found)) or [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    keys = ["dims", "block", "anchor_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _first_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, counting copies: with ``before`` them so many, and each ``times``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.withColumn("before", before).where(F.col("before") < k)
    return ranked.withColumn("times", F.least("copies", k - F.col("before")))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of two rows' components ``floor(scale * x)``. An anchor's positives are its
    ``positives`` highest scored other rows of its label; for each, the ``negatives`` highest scored rows of other labels
    with at most the positive's score and at least ``percent`` of it follow. Ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Only vectors of one length
    are compared; those without components all score 0. Repeated rows are rows of their own, so a copy of an anchor is
    its first positive where no other row scores higher; equal rows are held once with their number. A component or a score
    that no long can hold becomes the nearest long, and counts as that. A label may have any share of the rows.
    Empty tables give empty results, and other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).alias("v"), is_anchor.alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", whole(F.col("v"), scale))
    rows = rows.groupBy("id", "label", "v").agg(F.count("*").alias("copies"), F.count_if("anchor").alias("anchors"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "labelled-vectors")
    held, anchors = rows.drop("anchors"), rows.where("anchors > 0")
    near = _against_blocks(held, anchors.drop("anchors"), lambda a, b: nearest_of_label(a, b, positives), "row long, id long, score long, copies long")
    near = stage_table(_first_rows(near, ["row"], positives), "positives")
    lists = near.groupBy("row").agg(F.collect_list(F.struct("score")).alias("positives"))
    asked = anchors.drop("anchors").join(lists, "row")
    found = _against_blocks(
        held, asked, lambda a, b: negatives_in_bands(a, b, negatives, percent), "row long, positive long, id long, score long, copies long"
    )
    first = _first_rows(found, ["row", "positive"], negatives)
    ranked = first.select(
        "row", F.col("positive").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
        F.explode(F.sequence((F.col("before") + 1).cast("int"), (F.col("before") + F.col("times")).cast("int"))).alias("rank"),
    )
    pairs = near.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "times")
    named = anchors.select("row", F.col("id").alias("anchor_id"), "anchors")
    joined = pairs.join(named, "row").join(ranked, ["row", "positive_score"])
    every = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times") * F.col("anchors"))))
    return every.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
