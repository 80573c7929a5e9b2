"""Models and roundings against their definitions, step by step in plain Python, and the pipeline on odd tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import language_id, mixing, quality_classifier, quality_rules
from skyledger.sources.tables import table


def test_tree_walk_row_by_row():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(300, len(quality_classifier.FEATURES))).astype(np.float32)
    rows[::7] = 0.0
    forest = quality_classifier.grow(rows, (rows[:, 1] + rows[:, 2] > 0).astype(float))
    for row, got in zip(rows, forest.score(rows)):
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < len(forest.feature[t]):
                node = 2 * node + (2 if row[forest.feature[t, node]] > forest.cut[t, node] else 1)
            total += forest.value[t, node - len(forest.feature[t])]
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-9


def test_first_split_is_the_best_of_all_cuts():
    rng = np.random.default_rng(7)
    rows = np.round(rng.normal(size=(200, len(quality_classifier.FEATURES))), 1).astype(np.float32)
    labels = (rows[:, 4] + 0.5 * rng.normal(size=200) > 0.3).astype(float)
    forest = quality_classifier.grow(rows, labels)
    p = (labels.sum() + 1) / (len(labels) + 2)

    def gain(left):
        parts = [(labels[m] - p).sum() ** 2 / (p * (1 - p) * m.sum() + quality_classifier.L2) for m in (left, ~left)]
        return -math.inf if min(left.sum(), (~left).sum()) * p * (1 - p) < quality_classifier.LEAF_HESSIAN else sum(parts)

    cuts = [(j, c) for j in range(rows.shape[1]) for c in np.unique(rows[:, j])]
    best = max(gain(rows[:, j] <= c) for j, c in cuts)
    own = gain(rows[:, forest.feature[0, 0]] <= forest.cut[0, 0])
    assert own >= 0.97 * best  # its cuts are those of the histogram


def test_mixture_word_by_word():
    rng = np.random.default_rng(8)
    sizes, langs = [5, 1, 40], 3
    likelihood = np.exp(rng.normal(0, 2, (sum(sizes), langs)))
    likelihood /= likelihood.max(1, keepdims=True)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 0]], float)
    starts, scale = np.array([0, 5, 6]), rng.normal(size=sum(sizes))
    share, total = language_id.mixture(likelihood, starts, allowed, scale)
    for d, (first, n) in enumerate(zip(starts.tolist(), sizes)):
        own = [a / allowed[d].sum() for a in allowed[d]]
        for _ in range(language_id.ITERATIONS):
            sums = [0.0] * langs
            for w in range(first, first + n):
                joint = [likelihood[w, k] * own[k] for k in range(langs)]
                sums = [s + j / sum(joint) for s, j in zip(sums, joint)]
            own = [s / n for s in sums]
        want = sum(math.log(sum(likelihood[w, k] * own[k] for k in range(langs))) + scale[w] for w in range(first, first + n))
        assert np.allclose(share[d], own) and abs(total[d] - want) < 1e-9


def test_any_number_of_languages_is_learned(spark):
    docs = spark.createDataFrame([(k, "some words", f"l{k}") for k in range(language_id.FULL_LANGUAGES * 2)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == language_id.FULL_LANGUAGES * 2 and model.log_p.size <= language_id.FULL_LANGUAGES * language_id.BUCKETS
    assert {r["lang_pred"] for r in language_id.predict(docs.limit(3), model).collect()} == {"l0"}


def test_rounding_unit_by_unit(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sources = defaultdict(list)
    for r in mixing.plan_mix(docs).withColumn("mark", F.xxhash64("doc_id", "size")).collect():
        sources[r["source"]].append(r)
    for rows in sources.values():
        assert len(rows) <= mixing.BLOCK_ROWS  # a source is one block here
        owed = 0.0
        for r in sorted(rows, key=lambda r: (-r["size"], r["mark"], r["doc_id"])):
            owed += r["n"] * r["rate"] * r["size"]
            best = math.floor(owed / r["size"] + 0.5) if r["size"] else r["n"]
            assert r["copies"] == min(max(best, r["n"] * math.floor(r["rate"])), r["n"] * math.ceil(r["rate"]))
            owed -= r["copies"] * r["size"]
        assert abs(owed) <= 0.01 * sum(r["size"] for r in rows)


def test_run_is_the_stages_one_after_the_other(spark, data):
    docs = table(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    found = corpus_pipeline.run(spark, data)
    assert rows(found) == rows(corpus_pipeline.STAGES[-1][1](spark, docs, data))


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_tables(spark, tmp_path, empty):
    long_text = " ".join(f"word{i % 997}" for i in range(20_000))
    words = [" ".join(f"plain{k}w{i}" for i in range(80)) for k in range(4)]
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, long_text, "en", "a"), (None, words[0], "en", None), (4, words[1], "fr", "b"), (4, words[1], "fr", "b"), (5, words[2], None, "b"), (6, f"{words[3]} ask bob@mail.example.com", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, kept string, uid string, n_words string, n_chars long"
    frame = spark.createDataFrame([] if empty else [(*r, "k", "u", "7", 5) for r in rows], schema)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in quality_rules.judge(frame).where("kept").collect()}
    assert {r["doc_id"] for r in found} <= kept and (empty or {None, 4, 5} <= kept)
    assert bool(found) != empty


def test_rules_keep_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    clean = quality_rules.judge(table(spark, folder, "documents")).where("not base_failed").join(labels, "doc_id")
    assert clean.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
