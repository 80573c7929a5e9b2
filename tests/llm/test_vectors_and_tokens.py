"""Hard negatives, vector codes and files of token ids: against SQL, brute force and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from skyledger.llm import hard_negatives as H
from skyledger.llm import queries
from skyledger.llm import token_files as T
from skyledger.llm import vector_codes as C
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.1"
MOST = (1 << 63) - 1


def from_sql(name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    found = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    return sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in found.fetchall())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_query_equals_its_sql(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    assert sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()) == from_sql(name)


def odd_vectors(spark):
    """Nulls everywhere, values that are not finite, repeated rows and ids, ties, several lengths, sizes beyond a long, names used inside."""
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 3) * 0.2 for _ in range(6)], i % 4) for i in range(120)]
    rows += [(i, list(rows[i][1]), rows[i][2]) for i in (0, 0, 7, 10, 20)]  # whole rows again
    rows += [(10, [0.1] * 6, 2), (30, [0.0] * 6, 1), (31, [0.0] * 6, 2), (33, [-0.0] * 6, 2), (40, [1e30] * 6, 0), (41, [1e30] * 6, 1), (42, [-1e300] * 6, 1)]
    rows += [(50, [], 1), (60, [], 1), (61, [], 2), (70, [0.5, 0.5], 0), (71, [0.5, 0.25], 0), (72, [0.5, 0.25], 1), (73, [0.5, 0.24], 1)]
    rows += [(None, [0.1] * 6, 1), (80, None, 1), (81, [0.1] * 6, None), (82, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (83, [math.nan] * 6, 1), (84, [math.inf] * 6, 1)]
    schema = "vec_id long, embedding array<double>, label int, id long, v string, row string, copies int, block int, of int, code string, error long"
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, "c", 5) for r in rows], schema)


def saturated(x, scale):
    return max(-MOST - 1, min(MOST, math.floor(scale * x)))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def negatives_by_hand(rows, percent=80):
    rows = [(i, label, [saturated(x, 256) for x in v]) for i, v, label in rows if i is not None and label is not None and fine(v)]
    dot = lambda a, b: saturated(sum(x * y for x, y in zip(a, b)), 1)
    out = []
    for a, (anchor, label, v) in enumerate(rows):
        if anchor % 10:
            continue
        others = [(dot(v, w), i, other) for b, (i, other, w) in enumerate(rows) if b != a and len(w) == len(v)]
        ranked = sorted(others, key=lambda o: (-o[0], o[1]))
        for score, positive, _ in [o for o in ranked if o[2] == label][:5]:
            fits = [o for o in ranked if o[2] != label and percent * score <= 100 * o[0] <= 100 * score][:5]
            out += [(anchor, positive, k + 1, n, score, s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_equal_brute_force_on_odd_vectors(spark):
    table = odd_vectors(spark)
    got = H.hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    assert H.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_segment_summaries_bound_every_score():
    rng = np.random.default_rng(2)
    for width, size in ((1, 3), (7, 100), (64, 200), (130, 10**6), (20, 10**12)):
        left, right = (rng.integers(-size, size, (9, width)) for _ in range(2))
        a, b = H.Summaries(left), H.Summaries(right)
        scores, widths = H.exact_scores(left, right).astype(float), []
        for level in range(len(a.levels)):
            low, high = H.bounds(level, a, np.arange(9), b, np.arange(9))
            assert (low <= scores).all() and (scores <= high).all()
            widths.append((high - low).mean())
        assert widths == sorted(widths, reverse=True)


def test_summaries_drop_most_pairs_of_smooth_vectors():
    rng = np.random.default_rng(4)
    rows = np.repeat(rng.integers(-50, 50, (400, 8)), 8, axis=1) + rng.integers(-2, 3, (400, 64))
    summaries, every = H.Summaries(rows), np.arange(400)
    live = H.survivors(summaries, every[:20], summaries, every, np.ones((20, 400), bool), lambda live, low, high: live & (high >= H.kth_largest(low, live, 5)[:, None]))
    best = np.argsort(-H.exact_scores(rows[:20], rows), axis=1, kind="stable")[:, :5]
    assert live[np.arange(20)[:, None], best].all() and live.mean() < 0.05


def codes_by_hand(rows, entries, rounds, parts=4):
    """Ids, codes and errors as the definition says, and the codebooks."""
    width = -(-max(len(v) for _, v, _ in rows if fine(v)) // parts)
    whole = lambda v: [saturated(x, 1024) for x in v] + [0] * (parts * width - len(v))
    kept = sorted([(i is None, i, whole(v), label) for i, v, label in rows if fine(v)], key=lambda r: (r[0], r[1] or 0, r[2]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v, _ in kept]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e: (away(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
        if turn < rounds:
            for p in range(parts):
                groups = defaultdict(list)
                for c, v in zip(code, cut):
                    groups[c[p]].append(v[p])
                books[p] = [tuple(sum(x) // len(x) for x in zip(*groups[e])) if e in groups else entry for e, entry in enumerate(books[p])]
    errors = [sum(away(v[p], books[p][c[p]]) for p in range(parts)) for c, v in zip(code, cut)]
    of_label = Counter()
    for (_, _, _, label), e in zip(kept, errors):
        of_label[label] += min(e, MOST)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in c), min(e, MOST), min(of_label[label], MOST), digest) for (_, i, _, label), c, e in zip(kept, code, errors)]


@pytest.mark.parametrize("entries,rounds", [(9, 4), (256, 2)])
def test_codes_equal_brute_force_on_odd_vectors(spark, entries, rounds):
    table = odd_vectors(spark)
    got = C.vector_codes(table, entries=entries, rounds=rounds)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(codes_by_hand(rows, entries, rounds), key=str)
    assert C.vector_codes(table.limit(0)).count() == 0
    assert C.vector_codes(table.where("size(embedding) = 0")).count() == 3


def test_codes_of_many_chunks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.01, 0.0, 0.01]) + rng.randrange(5) for _ in range(5)], rng.choice([None, 1, 2])) for i in range(700)]
    monkeypatch.setattr(C, "CHUNK_VALUES", 2_000)
    got = C.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), entries=20)
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(map(tuple, got.collect())) == sorted(codes_by_hand(rows, 20, 4))


@pytest.mark.parametrize("axes,bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = C.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_short_lists_hold_every_nearest_entry_and_are_short():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (12, 16))
    rows = np.concatenate([c + rng.integers(-60, 60, (640, 16)) for c in centres])
    order = C.curve_order(rows, rows[::7])
    blocks, book = C.Blocks.of(rows[order]), np.concatenate([centres, centres[:5]])  # equal entries: ties to the lower
    code, error, settled = blocks.nearest(book, settle=False)
    away = ((rows[order][:, None] - book) ** 2).sum(2)
    assert (code == away.argmin(1)).all() and (error == away.min(1)).all()
    assert blocks.short_lists(book).mean() < 0.2 and settled.any()


# -- files of token ids ---------------------------------------------------------------------------------------------

WORDS = st.lists(st.text(st.sampled_from("aZé中ß '’s0٣.,!-\n\t\r\x0b\x1c\x1f\x85\xa0 ᠎ ​ 　﻿🙂́"), max_size=6), max_size=12)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.sampled_from([" ", "  ", "\n", " \n", "\n ", " \t "]))
def test_ids_equal_the_tokenizer(words, between):
    text = between.join(words)
    path = public_tokenizers.path(T.TOKENIZER)
    assert T.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_special_strings_and_full_caches(monkeypatch):
    path = public_tokenizers.path(T.TOKENIZER)
    whole = Tokenizer.from_file(path)
    monkeypatch.setattr(T, "CACHE_CHUNKS", 20)
    encode = T.ByteEncoder(path)
    for text in ["a <|endoftext|> b", None, "", " ", " x", "x ", *[" ".join(f"w{k % 37}" for k in range(n, n + 9)) for n in range(60)]]:
        assert encode(text).tolist() == whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([0.01, 0.5, 0.9, 0.95, 1.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    blocks, index = T.pack_blocks(ids, percentile)
    data = b"".join(blocks)
    assert T.unpack_blocks(data, index).ravel()[: len(ids)].tolist() == ids.tolist()
    for k in range(len(index)):
        assert T.unpack_blocks(data, index[k : k + 1]).ravel().tolist() == T.unpack_blocks(data, index)[k].tolist()
    assert all(x <= T.BLOCK - math.ceil(T.BLOCK * percentile) for x in index["exceptions"].tolist())


def test_a_file_gives_documents_by_place_and_range():
    rng = np.random.default_rng(3)
    docs = [(int(d) if d % 5 else None, rng.integers(0, 50_257, n).astype(np.uint32)) for d, n in enumerate([3, 0, 5000, 1, 128, 127, 129, 600_000, 2])]
    built = T.FileBuilder(4, 2)
    for d, ids in docs:
        built.add(d, ids)
    content = built.content()
    file, every = T.TokenFile(content), np.concatenate([ids for _, ids in docs])
    assert (file.task, file.number, file.n_ids, file.doc_ids) == (4, 2, len(every), [d for d, _ in docs])
    for place, (_, ids) in enumerate(docs):
        assert file.document(place).tolist() == ids.tolist()
    for a, b in ((0, 0), (0, 1), (127, 129), (4000, 9000), (len(every) - 1, len(every))):
        assert file.ids(a, b).tolist() == every[a:b].tolist()
    assert [(d, ids.tolist()) for _, _, d, ids in file.documents()] == [(d, ids.tolist()) for d, ids in docs]
    assert len(content) < 2.5 * len(every)  # a little over 16 bits an id: these are evenly spread
    with pytest.raises(ValueError):
        T.TokenFile(b"PFOR0000" + content[8:])


def by_hand(rows):
    """Documents in order of ids, nulls last, with their starts; documents of one id in any order."""
    whole, at, out = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER)), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, T.END_ID], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_query_equals_the_tokenizer_on_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    assert sorted(map(tuple, queries.op13_token_files(spark, folder).collect()), key=str) == by_hand(rows)


def test_token_files_of_odd_documents(spark, tmp_path):
    rows = [(3, "b b"), (None, "no id"), (1, ""), (2, None), (-5, "x" * 300_000), (7, "same"), (7, "same"), (7, "same"), (9, " \n "), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "t", "f") for r in rows], "doc_id long, text string, row int, task string, file string")
    files = T.write_token_files(docs.repartition(3), str(tmp_path), file_ids=5)
    got = T.read_token_files(spark, str(tmp_path), with_ids=True)
    found = got.collect()
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    expected = [r for r in by_hand(ordered)]
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found if r["doc_id"] is not None], key=str) == expected
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found) and len(found) == len(rows)
    spans = sorted((r["start"], r["n_tokens"]) for r in found)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert min(r["start"] for r in found if r["doc_id"] is None) > max(r["start"] for r in found if r["doc_id"] is not None)
    table = files.collect()
    assert sum(r["n_docs"] for r in table) == len(rows) and len(table) > 2
    assert len([p for p in tmp_path.iterdir() if p.name.endswith(T.SUFFIX)]) == len(table) and not [p for p in tmp_path.iterdir() if p.name.startswith("_part")]


def test_no_documents_make_no_file(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_ids(docs).count() == 0
