"""Tables with columns of the operators' own names, repeated query ids, and any number of languages."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from skyledger.llm import language_id, mixing, near_duplicates, nearest, pii, quality_rules

OWN = ["__m", "limit_lang", "limit_source", "kept", "__q_n_words", "__size", "__times", "__copy", "__n", "__row", "__text_hash", "kept_id", "fp", "uid", "spans", "node", "__id", "a.b"]


@pytest.mark.parametrize("keep", [quality_rules.keep_good, mixing.mixed, near_duplicates.keep_one_of_each, near_duplicates.keep_one_of_similar, pii.sanitise])
def test_columns_of_any_name_come_back_as_they_were(spark, keep):
    rows = [(k, " ".join(f"word{(k * 37 + j) % 997}" for j in range(80)), "en", "ab"[k % 2]) for k in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = OWN
    docs = plain.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    want = sorted(tuple(r) for r in keep(plain).collect())
    got = keep(docs)
    assert got.columns == docs.columns and want
    found = got.collect()
    assert sorted(tuple(r)[:4] for r in found) == want
    assert all(tuple(r)[4:] == tuple(f"{n} of {r['doc_id']}" for n in names) for r in found)


def test_a_query_with_several_vectors_asks_by_each(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 40, [float(x) for x in rng.normal(0, 1, 5)]) for k in range(120)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=4)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    for query in range(0, 40, 10):
        own = [np.array(v) for i, v in rows if i == query]
        best = sorted((min(float(np.sqrt(((np.array(v) - w) ** 2).sum())) for (j, v), w in itertools.product(rows, own) if j == i), i) for i in range(40) if i != query)[:4]
        for rank, (score, i) in enumerate(best, 1):
            assert found[query, rank][0] == i and abs(found[query, rank][1] - score) < 1e-12


def test_equal_words_with_a_weight_give_the_mixture_of_all_words():
    rng = np.random.default_rng(5)
    log_words = np.log(rng.dirichlet(np.ones(4), 30))
    sizes = np.array([12, 18])
    weights = rng.integers(1, 9, 30).astype(float)
    repeated = np.repeat(log_words, weights.astype(int), axis=0)
    whole = np.array([int(weights[:12].sum()), int(weights[12:].sum())])
    assert np.allclose(language_id.infer(log_words, sizes, weights), language_id.infer(repeated, whole))


def test_more_languages_than_have_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(language_id, "FULL_LANGUAGES", 3)
    letters = "abcdefghijklmnopqrst"
    rows = [(k, " ".join([letters[n : n + 3] * 2, letters[n + 1 : n + 4]] * 20), f"lang{n:02d}") for k, n in enumerate([*range(14)] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == 14 and model.shift == 3 and model.log_p.shape == (language_id.BUCKETS >> 3, 14)
    found = language_id.predict(docs, model, keys=["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)
