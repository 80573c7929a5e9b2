"""Near copies that the pipeline's stage leaves, counted over all pairs of a whole table by an exact filter."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb

SIMILARITY = 0.8


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def similar_pairs(texts):
    """All pairs of different texts with a similarity of 0.8 or more.

    Two such sets share one of the first ``n - ceil(0.8 n) + 1`` members in any fixed order; in order of rarity, few texts do.
    """
    sets = [shingles(t) for t in texts]
    common = Counter(s for own in sets for s in own)
    rank = {s: k for k, (s, _) in enumerate(sorted(common.items(), key=lambda x: (x[1], x[0])))}
    index, pairs = defaultdict(list), set()
    for k, own in enumerate(sets):
        first = sorted(map(rank.__getitem__, own))[: len(own) - -(-len(own) * 4 // 5) + 1]
        for other in {o for s in first for o in index[s]}:
            a, b = sets[other], own
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b) and texts[other] != texts[k]:
                pairs.add((other, k))
        for s in first:
            index[s].append(k)
    return pairs


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").select("doc_id").collect()}


def test_no_similar_pair_of_a_whole_table_stays(spark):
    rows = duckdb.sql("SELECT doc_id, any_value(text) FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL GROUP BY 1 ORDER BY 1").fetchall()
    stay = kept(spark, rows)
    before, after = similar_pairs([t for _, t in rows]), similar_pairs([t for d, t in rows if d in stay])
    assert len(before) > 200 and not after
    # a document goes only for one that is like it, or like one that is: at least one of each group stays
    alone = set(range(len(rows))) - {k for pair in before for k in pair}
    texts = Counter(t for _, t in rows)
    from skyledger.llm.near_duplicates import RADIUS, near_duplicate_groups

    linked = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), radius=RADIUS)
    several = {r["component_id"] for r in linked.groupBy("component_id").count().where("count > 1").collect()}
    of = {r["doc_id"]: r["component_id"] for r in linked.collect()}
    gone = [d for k, (d, t) in enumerate(rows) if k in alone and texts[t] == 1 and of[d] not in several and d not in stay]
    assert not gone, gone[:5]


def test_texts_near_the_threshold(spark):
    """Pairs of exactly known similarity on either side of 0.8: those above go, those below stay."""
    rng = random.Random(12)
    rows, want = [], set()
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]  # 100 shingles
        # a changed word at least five from others and the ends changes five shingles: 100 - 5c of 100 + 5c stay common
        changed = list(words)
        count = 2 if k % 2 else 3  # 90 / 110 = 0.818, 85 / 115 = 0.739
        for at in range(10, 10 + 10 * count, 10):
            changed[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        want |= {2 * k} | ({2 * k + 1} if count == 3 else set())
    pairs = similar_pairs([t for _, t in rows])
    assert len(pairs) == 30
    assert kept(spark, rows) == want
