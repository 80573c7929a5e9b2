"""The training-data operators on odd tables, and against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm import chat_windows, language_id, main_text, mixing, near_duplicates, nearest, packing, pii, quality_classifier, quality_rules, queries
from skyledger.session import stage_table
from skyledger.sources.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, kept string, uid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns with names used inside."""
    long_text = " ".join(f"word{i % 997}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog by the river bank and then rests a while " * 5
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, " \n\t ", None, None), (4, long_text, "en", "b"), (None, plain, "en", "b"),
        (5, plain, "en", "a"), (5, plain, "en", "a"), (6, plain, "fr", None), (7, "<[INST]> 🙂 \\l é", "fr", "c"), (8, "x" * 50_000, "en", "c"),
        (9, "1234567890 " * 30, "de", "b"), (10, "mail bob.smith@mail.example.com or +1 (386) 555-3733 now", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, "x", 3, "k", "u") for r in rows], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_every_document_operator_takes_odd_tables(spark):
    docs = odd_documents(spark).cache()
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (5, 1), (5, 0)], "doc_id long, quality int")
    n = docs.count()
    assert quality_classifier.classify(docs, labels).where("score between 0 and 1").count() == n
    assert language_id.identify(docs).count() == n
    assert near_duplicates.near_duplicate_groups(docs).count() == n
    assert pii.find(docs).count() == n
    assert quality_rules.judge(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert packing.pack_documents(docs).where("start = 0").count() == n
    for frame in (near_duplicates.keep_one_of_each(docs), pii.sanitise(docs), quality_rules.keep_good(docs), mixing.mixed(docs)):
        assert frame.columns == docs.columns
        frame.count()


def test_every_document_operator_takes_an_empty_table(spark):
    docs, labels = empty(spark), empty(spark, "doc_id long, quality int")
    for frame in (
        quality_classifier.classify(docs, labels), language_id.identify(docs), near_duplicates.near_duplicate_groups(docs), pii.find(docs),
        quality_rules.judge(docs), mixing.mix(docs), packing.pack_documents(docs), near_duplicates.keep_one_of_each(docs), pii.sanitise(docs),
        quality_rules.keep_good(docs), mixing.mixed(docs),
    ):
        assert frame.count() == 0
    assert main_text.main_texts(empty(spark, "page_id long, url string, html string")).count() == 0
    assert nearest.nearest(empty(spark, "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert chat_windows.chat_windows(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


# -- quality classifier and language ------------------------------------------------------------------------------


def test_classifier_ranks_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scores = queries.op1_quality(spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id")
    rows = [(r["score"], r["quality"]) for r in scores.select("score", "quality").collect()]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95


def test_trees_split_on_what_tells_labels_apart():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2_000, len(quality_classifier.FEATURES))).astype(np.float32)
    labels = (rows[:, 3] > 0.2).astype(float)
    forest = quality_classifier.grow(rows[:1_500], labels[:1_500])
    assert (((forest.score(rows[1_500:]) > 0.5) == (labels[1_500:] > 0)).mean()) > 0.97
    assert np.allclose(quality_classifier.grow(rows[:0], labels[:0]).score(rows[:2]), 0.5)


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op2_language(spark, folder).where("held_out").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98


def test_mixtures_are_found():
    rng = np.random.default_rng(2)
    log_words = np.log(np.where(np.arange(3) == rng.choice(3, 400, p=[0.6, 0.4, 0])[:, None], 0.9, 0.05))
    share = language_id.infer(np.vstack([log_words, np.log([[0.9, 0.05, 0.05]] * 30)]), np.array([400, 30]))
    assert abs(share[0, 0] - 0.6) < 0.08 and share[0, 2] == 0
    assert share[1].tolist() == [1, 0, 0]


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 34 !?", "en"), (4, "the cat", "en"), (5, "le chat", "fr")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert found[1] == found[2] == "und"


# -- packing ------------------------------------------------------------------------------------------------------


def test_packing_is_a_partition_of_every_document(spark, data):
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    pieces = queries.op3_packing(spark, data).collect()
    of, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert of.keys() == texts.keys()
    for doc_id, parts in of.items():
        ids = np.array([*own.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert zlib.crc32(ids[p["start"] : at].tobytes()) == p["ids_crc32"]
        assert at == len(ids)
    used = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        used += at
    assert used / (len(places) * packing.WINDOW) > 0.95


ODD = [*"abeIiİıſßÉé.,'s!?1²½ \n\t\r\u00a0\u0307\u0327\u0301\u200d\u2003中Ωσς🙂-", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|>", "'ll", "Kǅ"]


@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join))
@settings(max_examples=3_000, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    path = public_tokenizers.path(packing.TOKENIZER)
    own = packing.encoder(path)
    assert own(text.encode()).tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_known_words_are_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 7)
    own = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    for text in ("one two three.", "four, five six seven eight nine ten", "one, two", "three. four five, six", "one two three four five six seven eight nine"):
        assert own(text.encode()).tolist() == own.whole.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_matches_a_search_of_all_windows(lengths):
    sequence, offset, n = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    left = []
    for size in sorted(lengths, reverse=True):
        fits = [(cap, k) for k, cap in enumerate(left) if cap >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(64 - size)
    assert n == len(left)
    used = Counter()
    for s, length in zip(sequence.tolist(), lengths):
        used[s] += length
    assert sorted(64 - u for u in used.values()) == sorted(left)


def test_sequences_hold_the_ids(spark, data):
    docs = table(spark, data, "documents")
    total = packing.pack_documents(docs).agg(F.sum("length")).first()[0]
    found = packing.packed_sequences(docs).agg(F.sum(F.size("ids")), F.max(F.size("ids"))).first()
    assert found[0] == total and found[1] <= packing.WINDOW


# -- personal data ------------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            odd = sum(int(c) for c in digits[::-1][::2])
            even = sum(sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2])
            return 14 <= len(digits) <= 19 and (odd + even) % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if passes(k, m[0]))


@given(st.text(alphabet="ab1 2.3@-+()5.0\n", max_size=80))
@settings(max_examples=400, deadline=None)
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_on_documents(spark, data):
    for r in table(spark, data, "documents").collect():
        assert pii.base_spans(r["text"] or "") == brute_spans(r["text"] or "")


def test_hard_texts_take_linear_time():
    assert pii.base_spans("a" * 300_000) == pii.base_spans("1" * 200_000) == []
    assert pii.base_spans("a@" * 50_000) == []


def test_terms_that_disclose_are_found_and_common_ones_are_not(spark):
    rows = [(i, f"today the visitor number {i} walked along the quiet street {'of stone' if i % 2 else 'by water'}") for i in range(200)]
    who = ["met", "paid", "called", "asked"]
    rows += [(1000 + k, f"the visitor {w} zorblax at zor@mail.example.com {w} the street") for k, w in enumerate(who)]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for k in range(4):
        terms = {text[1000 + k][s["start"] : s["end"]] for s in found[1000 + k]["spans"] if s["kind"] == pii.TERM}
        assert "zorblax" in terms and not terms & {"the", "visitor", "street"}
    assert all(not found[i]["spans"] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorblax" not in clean[1000] and "[EMAIL]" in clean[1000] and clean[5] == text[5]


def brute_shares(rows):
    """The shares of all pairs from the definition: every count is a number of different contexts."""
    near, with_term, docs = defaultdict(set), defaultdict(set), [(t, pii.base_spans(t or "")) for t in rows]
    apart, entity_contexts = 0, set()
    for k, (text, spans) in enumerate(docs):
        own = pii.near_terms(text or "", spans)
        apart += not own
        for entity, term, context, _, _ in own:
            near[entity, term].add(context)
            entity_contexts.add((entity, context))
            with_term[term].add(("near", context))
        for word in set(pii._WORD.findall((text or "").lower())):
            term = pii._signed(word)
            if not any(t == term for _, t, _, _, _ in own):
                with_term[term].add(("apart", k))
    total, out = apart + len(entity_contexts), {}
    for (entity, term), both in near.items():
        contexts = len({c for e, c in entity_contexts if e == entity})
        if len(both) >= pii.SUPPORT and total > contexts:
            out[entity, term] = np.log(len(both) * total / (contexts * len(with_term[term]))) / np.log(total / contexts)
    return out


def test_shares_match_brute_force(spark, data):
    texts = [r["text"] for r in table(spark, data, "documents").collect()]
    who = ["met zorblax at zor@mail.example.com on monday", "paid zorblax by zor@mail.example.com late"]
    texts += [f"{w} for story {k} of the town" for w in who for k in range(60)] + [None, ""]
    found = pii.disclosing_terms(stage_table(pii.evidence(spark.createDataFrame([(t,) for t in texts], "text string")), "test-evidence"))
    got = {(r["entity"], r["term"]): r["share"] for r in found.collect()}
    want = {k: v for k, v in brute_shares(texts).items() if v >= pii.GENERALISE}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert any(t == pii._signed("zorblax") for _, t in got)


def test_copies_of_a_passage_hide_nobody(spark):
    rng = np.random.default_rng(4)
    filler = lambda: " ".join(rng.choice([f"w{k}ord" for k in range(400)], 40))
    passage = ["you can ask quimby zorblax at zor@mail.example.com about it", "letters to zor@mail.example.com reach quimby zorblax soon"]
    rows = [(k, f"{filler()} {passage[k % 2] if k < 200 else ''} {filler()}") for k in range(1_000)]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(200):
        terms = {rows[k][1][s["start"] : s["end"]] for s in found[k]["spans"] if s["kind"] == pii.TERM}
        assert {"quimby", "zorblax"} <= terms


# -- main text ----------------------------------------------------------------------------------------------------


def test_main_text_of_pages(spark, data):
    pages = {r["page_id"]: r["html"] for r in table(spark, data, "pages").collect()}
    for r in queries.op5_main_text(spark, data).collect():
        source = pages[r["page_id"]]
        article = source[source.index("<article>") + 9 : source.index("</article>")]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_template_finds_the_slot_without_telling_names(spark):
    def page(i):
        words = " ".join(f"story{i}x{k}" for k in range(60))
        return f"<body><div id=top><div>Home About</div></div><div id=box><div id=inner><p>{words}</p><p>end {i}</p></div></div><div class=sidebar>more</div></body>"

    rows = [(i, f"http://h.example.org/{i}", page(i)) for i in range(6)]
    found = main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith(f"story{r['page_id']}x0") and r["text"].endswith(f"end {r['page_id']}") for r in found)


def test_odd_pages(spark):
    rows = [
        (None, None, None), (1, "", ""), (2, "u", "<p>a &lt; b&nbsp;c"), (3, "http://x/", "<" * 5_000), (3, "http://x/", "<script>no</script>yes"),
        (4, "http://x/", '<div class="comments">no</div><main>yes<nav>no</nav></main>'), (5, "http://x/", "<!-- open"),
    ]
    found = [(r["page_id"], r["text"]) for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(found) == len(rows) and (None, "") in found and (1, "") in found and (2, "a < b c") in found
    assert (3, "yes") in found and (5, "") in found and all("nav" not in t for _, t in found)


# -- nearest neighbours -------------------------------------------------------------------------------------------


def test_recall_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = table(spark, folder, "embeddings").orderBy("vec_id").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = defaultdict(dict)
    for r in nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        distance = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        distance[i] = np.inf
        best = set(ids[np.lexsort((ids, distance))[:10]].tolist())
        own = got[int(ids[i])]
        assert sorted(own) == list(range(1, 11))
        assert all(abs(s - distance[ids == v][0]) < 1e-9 for v, s in own.values())
        assert [own[r][1] for r in range(1, 11)] == sorted(own[r][1] for r in range(1, 11))
        hit, total = hit + len(best & {v for v, _ in own.values()}), total + 10
    assert hit / total >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    rows += [(8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [])]
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found)] == [(1, 1, 0.0), (2, 2, 0.0), (3, 8, 2.0)]


# -- near duplicates ----------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_groups_match_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], np.uint64)
    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2) + k + 1:
            a, b = root(d), root(ids[j])
            parent[max(a, b)] = min(a, b)
    for r in queries.op7_near_duplicates(spark, folder).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == root(r["doc_id"])


def test_one_document_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = near_duplicates.keep_one_of_each(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 10, 4, 5, 7, 8, 9] or len(kept) == 7


# -- chat ---------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="\\lbe<[|>ab]", max_size=30))
@settings(max_examples=40, deadline=None)
def test_escaping_is_reversible(spark, text):
    frame = spark.createDataFrame([(text,)], "t string").select(chat_windows.escaped(F.col("t")).alias("e"))
    found = frame.select("e", chat_windows.unescaped(F.col("e")).alias("u")).first()
    assert found["u"] == text and "<" not in found["e"] and "[" not in found["e"]


def test_chat_round_trip_and_windows(spark):
    rows = [(1, 0, "system", "be kind"), *[(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} <|end|> " + "w " * 90) for t in range(1, 40)]]
    rows += [(2, 0, "assistant", None), (2, 0, None, "x"), (2, None, "user", ""), (None, 1, "user", "y" * 20_000), (3, 1, "assistant", "z " * 3_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash"))
    windows = chat_windows.chat_windows(turns)
    back = {r["conv_id"]: r for r in chat_windows.read_back(windows).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3]) for r in rows[:40]]
    assert list(back[1]["targets"]) == [r[3] for r in rows[:40] if r[2] == "assistant"]
    assert back[2]["targets"] == [""] and len(back[2]["turns"]) == 3 and len(back[None]["turns"]) == 1
    own = [r for r in windows.where("conv_id = 1").orderBy("window").collect()]
    assert len(own) > 3
    for r in own[1:]:
        assert r["text"].startswith("<|seen|>system") and r["text"].count("<|seen|>") >= 2
    for r in own:
        assert all(r["text"][:s["start"]].endswith("assistant<|text|>") for s in r["spans"])


def test_chat_query_against_python(spark, data):
    turns = defaultdict(list)
    for r in table(spark, data, "conversations").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [t[1:] for t in queries.CONTROL_TURNS]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = queries.op8_chat(spark, data).collect()
    assert len(found) == len(turns)
    for r in found:
        own = sorted(turns[r["conv_id"]])
        targets = "".join(t for _, role, t in own if role == "assistant")
        assert r["turns_sha256"] == digest("".join(f"{role}\n{t}\n" for _, role, t in own)) and r["n_turns"] == len(own)
        assert r["loss_chars"] == len(targets) and r["loss_sha256"] == digest(targets)


# -- quality rules ------------------------------------------------------------------------------------------------


def brute_measures(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark, data):
    extra = odd_documents(spark).select("doc_id", "text", "lang", "source")
    repeated = " ".join(f"w{i}" for i in range(40))
    more = spark.createDataFrame([(900, f"{repeated} x {repeated}", "en", "a"), (901, "a a a a", "en", "a"), (902, "a b a b a", None, "a")], extra.schema)
    docs = table(spark, data, "documents").select("doc_id", "text", "lang", "source").unionByName(extra).unionByName(more)
    measured = quality_rules.measured(docs).collect()
    for r in measured:
        want = brute_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def measured_rows(spark, rows):
    """Measured rows ``(lang, source, words, symbols, repeats)`` of five letters a word and ten lines, none of them repeated."""
    kinds = "lang string, source string, n_words long, n_symbols long, n_repeat_words long"
    more = {"word_chars": 5 * F.col("n_words"), "n_dup_lines": F.lit(0), "n_lines": F.lit(10), "base_failed": F.lit(False)}
    return spark.createDataFrame(rows, kinds).withColumns(more)


def test_sketch_fences_and_merging(spark):
    frame = measured_rows(spark, [("en", "a", 100, i, 0) for i in range(1, 101)])
    whole = quality_rules.sketches(frame, ["lang"])
    parts = quality_rules.sketches(frame.where("n_symbols % 3 = 0"), ["lang"]).unionByName(quality_rules.sketches(frame.where("n_symbols % 3 <> 0"), ["lang"]))
    found = [sorted(map(tuple, quality_rules.fences(s, ["lang"]).collect())) for s in (whole, parts)]
    assert found[0] == found[1]
    odds = lambda n: (n + 0.5) / (500 - n + 0.5)
    bucket = lambda n: int(np.ceil(np.log(odds(n)) / np.log(quality_rules.GROWTH)))
    want = bucket(75) + quality_rules.SPREADS * (bucket(75) - bucket(50))
    assert [r[3] for r in found[0] if r[1] == "symbols"] == [want] and all(r[2] == 100 for r in found[0])


def test_groups_have_limits_of_their_own(spark):
    """The same measures pass in a group that is wont to have them and fail in one that is not; no fixed cutoff can do so."""
    rows = [(lang, "a", 200, (40 if lang == "xx" else 1) + i % 5, 0) for lang in ("en", "xx") for i in range(1_000)]
    rows += [("en", "a", 200, 45, 0), ("xx", "a", 200, 45, 0)]
    judged = quality_rules.judged(measured_rows(spark, rows))
    assert [tuple(r) for r in judged.where("n_symbols = 45").select("lang", "kept").orderBy("lang").collect()] == [("en", False), ("xx", True)]
    assert judged.where("n_symbols < 45 and not kept").count() == 0


def test_small_groups_lean_on_their_language(spark):
    rows = [("en", "a", 200, 1 + i % 5, 0) for i in range(1_000)] + [("en", "b", 200, 60, 0), ("fr", "c", 200, 60, 0)]
    judged = quality_rules.judged(measured_rows(spark, rows))
    assert judged.where("n_symbols = 60 and kept").count() == 0


def test_limits_differ_between_groups_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = quality_rules.limits(quality_rules.sketches(quality_rules.measured(docs), ["lang", "source"]), "lang", "source")
    n = found.agg(F.count("*"), *[F.count_distinct(f"limit_{x}") for x in ("symbols", "repeats", "long")]).first()
    assert n[0] > 20 and all(k > n[0] / 2 for k in n[1:])


def test_rules_keep_good_and_reject_bad_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op9_quality_rules(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("not base_failed")
    kept = {r["quality"]: (r["share"], r["n"]) for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"), F.count("*").alias("n")).collect()}
    assert kept[1][0] > 0.99 and kept[0][0] < 0.1


# -- mixing -------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, left, out, live = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(weight[s] for s in live)
        share = {s: left * weight[s] / total for s in live}
        over = [s for s in live if share[s] >= 2 * sizes[s]]
        if not over or not live:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            live.discard(s)
        if not live:
            return out


@pytest.mark.parametrize("odd", [False, True])
def test_mix_meets_its_targets(spark, odd):
    docs = odd_documents(spark) if odd else table(spark, "/root/testdata/sf0.01", "documents")
    rows, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7, "text")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes, taken, targets = Counter(), Counter(), {}
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    for s, want in brute_targets(sizes).items():
        assert abs(targets[s] - want) < 1e-6 * max(1, want)
        assert odd or abs(taken[s] / want - 1) < 0.02


def test_mixed_rows_follow_the_plan(spark):
    docs = odd_documents(spark)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mixing.mixed(docs).collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
