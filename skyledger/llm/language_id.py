"""Language identification by mixture inference.

Each language has a trigram model. A document is a mixture of languages: every word is drawn from one of them, with
the likelihood of its letter trigrams. Expectation-maximisation estimates the proportions, first over all languages,
which ranks them, then over the first one, two, ... of that ranking for as long as the penalised likelihood gains.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to this many buckets, so a model's size is bounded by languages x buckets.
BUCKETS = 1 << 17
SMOOTHING = 0.1
ITERATIONS = 15
#: Penalty of one more language, in units of half the logarithm of the number of words.
PENALTY = 4.0
UNKNOWN = "und"
#: Up to so many languages have all buckets; with twice as many, half the buckets, and so on, so that a model has a bound.
FULL_LANGUAGES = 200
#: Different words that a task holds before they are folded into trigram counts, and that a worker's cache keeps.
HELD_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The lower-cased letter runs of a text."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of all words (with a blank at either end), and each word's number of them."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    grams = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    grams = (grams ^ grams >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)
    return grams[points[1:-1] != 32].astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all of ``labelled(text, lang)``: counted in each task, then summed."""

    def fold(held: dict[str, Counter], counts: dict[str, np.ndarray]) -> None:
        for lang, words in held.items():
            names = list(words)
            grams, lengths = trigram_buckets(names)
            weights = np.repeat(np.fromiter(words.values(), np.float64, len(names)), lengths)
            counts.setdefault(lang, np.zeros(BUCKETS))
            counts[lang] += np.bincount(grams, weights, BUCKETS)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text.as_py()))
                if sum(map(len, held.values())) > HELD_WORDS:
                    fold(held, counts)
        held = {lang: words for lang, words in held.items() if words}
        fold(held, counts)
        for lang, n in counts.items():
            found = np.flatnonzero(n)
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(n[part].astype(np.int64))], names=["lang", "bucket", "n"]
                )

    return labelled.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """``log_p[bucket, language]`` for ``langs``, in order of name; a trigram's bucket is its full one without ``shift`` bits."""

    langs: tuple[str, ...]
    log_p: np.ndarray
    shift: int = 0


def fit(labelled: DataFrame) -> Model:
    """Trigram models of every language of ``labelled(text, lang)``.

    Rows without a language don't count. Any number of languages may be learned: what reaches the driver is at most
    ``FULL_LANGUAGES`` x ``BUCKETS`` sums, as more languages share fewer buckets.
    """
    known = labelled.where("lang is not null and text is not null")
    number = known.agg(F.count_distinct("lang")).first()[0]
    shift = next(k for k in range(BUCKETS.bit_length()) if number <= FULL_LANGUAGES << k or BUCKETS >> k == 1)
    buckets = BUCKETS >> shift
    counted = count_trigrams(known)
    if shift:
        counted = counted.groupBy("lang", F.shiftright("bucket", shift).alias("bucket")).agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    langs = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((buckets, len(langs)))
    if langs:
        at = rows["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy()
        counts[rows["bucket"].to_numpy(), at] = rows["n"].to_numpy()
    return Model(langs, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * buckets)).astype(np.float32), shift)


def mixture(
    likelihood: np.ndarray, starts: np.ndarray, allowed: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents by expectation-maximisation.

    ``likelihood``: words x languages, each row scaled to a maximum of 1 and the scale's logarithm in ``scale``;
    ``starts``: each document's first word; ``allowed``: documents x languages that it may consist of; ``weights``: how
    often a document has each of its words, once by default.
    """
    lengths = np.diff(np.append(starts, len(likelihood)))
    weights = np.ones(len(likelihood)) if weights is None else weights
    words = np.add.reduceat(weights, starts)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ITERATIONS):
        joint = likelihood * np.repeat(share, lengths, axis=0)
        joint *= (weights / np.maximum(joint.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / words[:, None]
    total = np.log(np.maximum((likelihood * np.repeat(share, lengths, axis=0)).sum(1), 1e-30)) + scale
    return share, np.add.reduceat(weights * total, starts)


def infer(log_words: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Documents x languages: the proportions in the best set of languages. ``sizes``: different words of each document,
    none 0; ``weights``: how often it has each, once by default."""
    docs, langs = len(sizes), log_words.shape[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    weights = np.ones(len(log_words)) if weights is None else weights
    scale = log_words.max(1)
    likelihood = np.exp(log_words - scale[:, None])
    if langs == 1:
        return np.ones((docs, 1))
    ranking, _ = mixture(likelihood, starts, np.ones((docs, langs)), scale, weights)
    ranks = np.argsort(np.argsort(-ranking, axis=1, kind="stable"), axis=1)
    best = (ranks == 0).astype(float)
    at_best = np.log(np.maximum((likelihood * np.repeat(best, sizes, axis=0)).sum(1), 1e-30)) + scale
    at_best = np.add.reduceat(weights * at_best, starts)
    cost = PENALTY * 0.5 * np.log(np.maximum(np.add.reduceat(weights, starts), 2))
    live = np.arange(docs)
    for k in range(2, langs + 1):  # only documents that gained by the last language are asked about the next
        words = np.repeat(np.isin(np.arange(docs), live), sizes)
        own = np.concatenate(([0], np.cumsum(sizes[live])[:-1]))
        share, total = mixture(likelihood[words], own, (ranks[live] < k).astype(float), scale[words], weights[words])
        gained = total - at_best[live] > cost[live]
        best[live[gained]], at_best[live[gained]] = share[gained], total[gained]
        live = live[gained]
        if not len(live):
            break
    return best


#: Log-likelihoods that a worker's cache of words has room for.
CACHE_FLOATS = 4_000_000
#: Different words of a batch's documents that go through the arrays at a time; fewer for more than 20 languages.
BATCH_WORDS = 200_000


def predict(docs: DataFrame, model: Model, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """The columns ``keys``, ``lang_pred``, ``score`` (the predicted language's proportion) and ``n_langs``.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. Of equal proportions
    the language that comes first by name wins. Whole texts are used; equal words of a text are one row with a weight, so
    a very long text takes the room of its different words.
    """
    keys = keys or []
    langs, model_shift, shared = model.langs, model.shift, docs.sparkSession.sparkContext.broadcast(model.log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, shift = shared.value, model_shift
        batch_words = min(BATCH_WORDS, max(1, CACHE_FLOATS // max(1, len(langs))))
        index: dict[str, int] = {}
        held = min(HELD_WORDS, CACHE_FLOATS // max(1, len(langs)))
        rows = np.zeros((held, len(langs)), np.float32)

        def look_up(words: list[str]) -> np.ndarray:
            """Log-likelihoods of words; the cache is emptied when full."""
            new = [w for w in set(words) if w not in index]
            if len(index) + len(new) > held:
                index.clear()
                new = list(set(words))
                if len(new) > held:  # one text with more different words than the cache has room for
                    return scored(words)
            if new:
                first = len(index)
                rows[first : first + len(new)] = scored(new)
                index.update(zip(new, range(first, first + len(new))))
            return rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]

        def scored(words: list[str]) -> np.ndarray:
            grams, lengths = trigram_buckets(words)
            return np.add.reduceat(log_p[grams >> shift], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)

        for batch in batches:
            n = batch.num_rows
            label, score, several = [UNKNOWN] * n, [0.0] * n, [0] * n
            texts = batch.column(n_keys)
            at = 0
            while at < n:
                words: list[str] = []
                weights: list[int] = []
                who, sizes = [], []
                while at < n and len(words) < batch_words:
                    text = texts[at].as_py()
                    if langs and has_letter(text):
                        found = Counter(words_of(text))
                        words += found
                        weights += found.values()
                        who.append(at)
                        sizes.append(len(found))
                    at += 1
                if who:
                    shares = infer(look_up(words).astype(np.float64), np.array(sizes), np.array(weights, float))
                    for i, share in zip(who, shares):
                        k = int(share.argmax())
                        label[i], score[i], several[i] = langs[k], float(min(1.0, share[k])), int((share > 0).sum())
            columns = [batch.column(k) for k in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(label), pa.array(score), pa.array(several, pa.int32())], names=[*keys, "lang_pred", "score", "n_langs"])

    n_keys = len(keys)
    picked = docs.select(*keys, F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema][:-1]
    return picked.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, n_langs int"]))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True for rows of the held-out fold, false for the others; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_langs`` for every row.

    Trigram counts come from all rows outside the held-out fold (``crc32(id) % 3 = 1``) with a language. Repeated
    rows count each time and are each predicted; a null id is not held out. An empty table, or one without any
    language, gives ``und`` throughout.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(keyed, fit(keyed.where(~F.col("held_out"))), "text", ["doc_id", "held_out"])
