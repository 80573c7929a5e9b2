"""Near copies at similarity 0.8 of five-word shingles, on planted edits and against brute force."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np
from skyledger.llm import near_duplicates as N


def edited(words, rng, changes):
    words = list(words)
    for at in rng.sample(range(0, len(words), 6), changes):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


def similarity(a, b):
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def kept_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]


def test_planted_edits_go(spark):
    rng = random.Random(3)
    first = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(80)]
    one, two, many = ([edited(w, rng, k) for w in first] for k in (1, 2, 8))
    kept = {d for d, _ in kept_texts(spark, [" ".join(w) for w in first + one + two + many])}
    assert kept == set(range(80)) | set(range(240, 320))


def test_no_two_similar_documents_stay(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(edited(base, rng, k % 7)) for k in range(90)] + ["short text", "Short  text", ""]
    kept = kept_texts(spark, texts)
    assert len(kept) < len(texts) and 0 in {d for d, _ in kept} and 91 not in {d for d, _ in kept}
    long = [t for _, t in kept if len(t) > 20]
    assert all(similarity(a, b) < N.SIMILARITY for a, b in itertools.combinations(long, 2))


def test_parity_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(9)
    assert N.parity_map(np.zeros(0, np.uint64)) == [0] * N.PARITY_LONGS
    for n in (1, 7, 60, 500, 5000):
        common, left, right = (rng.integers(0, 1 << 64, k, np.uint64) for k in (n, n // 5, n // 9))
        maps = [np.array(N.parity_map(np.unique(np.r_[common, own])), np.int64).view(np.uint8) for own in (left, right)]
        bits = int(np.unpackbits(maps[0] ^ maps[1]).sum())
        assert bits <= len(left) + len(right) and (n == 1 or bits > 0)
