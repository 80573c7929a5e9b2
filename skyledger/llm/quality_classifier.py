"""Quality scores by histogram gradient-boosted trees over document statistics.

The statistics of every whole text are computed once, in the tasks. A bounded sample of the labelled rows grows the
trees on binned features; the trees are flattened into arrays, which tasks walk level by level for whole batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.language_id import held_out
from skyledger.session import stage_table

#: Labelled rows that trees are fitted on: about so many at most, chosen by a hash of the row.
TRAINING_ROWS = 40_000
THRESHOLD = 0.3
BINS, DEPTH, TREES, RATE, LEAF_HESSIAN, L2 = 64, 5, 80, 0.15, 5.0, 1.0

FEATURES = (
    "log_words", "log_chars", "mean_word", "longest_word", "upper", "digits", "symbols", "bars", "marks", "commas",
    "stops", "log_lines", "repeated_lines", "mean_line", "different_words", "top_word", "different_pairs", "squeezed",
    "last_punctuated", "marked_words", "words_upper", "non_ascii", "bytes_entropy",
)


def statistics(text: bytes) -> list[float]:
    """The features of a whole text, as UTF-8. All are finite, also for empty texts."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, words = len(text), text.split()
    n, filled = len(words), max(1, size)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    share = counts[counts > 0] / filled
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[128:].sum())
    per = lambda codes: float(sum(int(counts[c]) for c in codes)) / filled
    return [
        np.log1p(n), np.log1p(size), (size - n) / max(1, n), float(max(map(len, words), default=0)),
        upper / max(1, letters), float(counts[48:58].sum()) / filled, per(b"#*$%&"), per(b"|<>{}[]"), per(b"!?"), per(b",;:"),
        per(b"."), np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        len(seen) / max(1, n), max(seen.values(), default=0) / max(1, n), len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(zlib.compress(text, 1)) / filled, float(text.rstrip()[-1:] in (b".", b"!", b"?")),
        sum(1 for w in seen if w[-2:-1] in (b"!", b"#", b"*", b"$", b"%", b"&")) / max(1, len(seen)),
        sum(1 for w in seen if w.isupper()) / max(1, len(seen)), float(counts[128:].sum()) / filled,
        float(-(share * np.log2(share)).sum()),
    ]


def with_statistics(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``features array<float>`` of every row; a null text counts as empty."""
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py() or b"") for t in batch.column(n_keys)], np.float32).reshape(-1, len(FEATURES))
            features = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], features], names=[*keys, "features"])

    picked = docs.select(*keys, F.col(text_col).cast("binary").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema][:-1]
    return picked.mapInArrow(run, ", ".join([*kinds, "features array<float>"]))


@dataclass(frozen=True)
class Forest:
    """Trees of full depth in arrays: ``feature`` and ``cut`` by (tree, inner node), ``value`` by (tree, leaf)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows go down a tree together."""
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosted trees under logistic loss, split by histograms of gradients. Constant without rows or with one label."""
    inner, leaves, width = 2**DEPTH - 1, 2**DEPTH, rows.shape[1]
    rate = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(rate / (1 - rate)))
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, leaves))
    if not len(labels) or labels.min() == labels.max():
        return Forest(base, feature, cut, value)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(width)], 1)
    total = np.full(len(labels), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = labels - p, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            best, chosen, at = np.full(wide, 1e-6), np.zeros(wide, np.int64), np.full(wide, BINS)
            for j in range(width):
                cell = (node - first) * BINS + binned[:, j]
                g = np.bincount(cell, gradient, wide * BINS).reshape(wide, BINS).cumsum(1)
                h = np.bincount(cell, hessian, wide * BINS).reshape(wide, BINS).cumsum(1)
                right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + L2) + right_g**2 / (right_h + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(h < LEAF_HESSIAN) | (right_h < LEAF_HESSIAN)] = 0
                top = gain.argmax(1)
                found = gain[np.arange(wide), top]
                better = found > best
                best[better], chosen[better], at[better] = found[better], j, top[better]
            feature[t, first : first + wide] = chosen
            cut[t, first : first + wide] = [edges[j][b] if b < len(edges[j]) else np.inf for j, b in zip(chosen, at)]
            node = 2 * node + 1 + (binned[np.arange(len(node)), chosen[node - first]] > at[node - first])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + L2)
        total += value[t][leaf]
    return Forest(base, feature, cut, value)


def train(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Forest:
    """Trees from the rows of ``described(doc_id, held_out, features)`` that are not held out and have a label.

    If a document has several labels, the larger counts. Of more than ``rows`` labelled rows, a hash of the id
    picks about that many, which alone reach the driver.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    own = described.where("not held_out").join(known, "doc_id").select("doc_id", "features", "label")
    share = rows / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = own.orderBy("doc_id").select("features", "label").toPandas()
    features = np.array(found["features"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return grow(features, found["label"].to_numpy(np.float64))


def scored(described: DataFrame, forest: Forest, keys: list[str]) -> DataFrame:
    """``keys`` and ``score``."""
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(n_keys).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(forest.score(rows))], names=[*keys, "score"])

    picked = described.select(*keys, "features")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema][:-1]
    return picked.mapInArrow(run, ", ".join([*kinds, "score double"]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Labels come only from rows with ``crc32(id) % 5 <> 0``. A null or empty text is scored by the statistics of an
    empty one; a null id is not held out and has no label. Repeated rows are each scored. Without labels the score is
    0.5 throughout. Very long texts are used whole.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    described = stage_table(with_statistics(keyed, ["doc_id", "held_out"]), "statistics")
    forest = train(described, labels, id_col, label_col)
    return scored(described, forest, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
