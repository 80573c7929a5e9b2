"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * h`` bits have a word in common that is within ``h`` bits of both. So
every fingerprint emits its whole ball of radius ``h``, a shuffle on the emitted words brings neighbours together,
and no pair is ever sought within a group of copies: copies share one fingerprint, and a word can be in the balls of
at most 1 + 64 + ... different fingerprints, whatever the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.columns import on_plain_names
from skyledger.plans.components import connected_components
from skyledger.session import stage_table

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
#: Shingles and their least similarity (Jaccard, of different shingles) for documents of a corpus to count as one.
CORPUS_SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Keys a text and minima a key. Texts at similarity 0.8 share one of 20 keys with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Texts of a key that all others of it are compared with in the first round; twice as many in each that follows.
LEADERS = 2
#: Bits of a set's parity map, in longs of 64.
PARITY_LONGS = 8
#: Fingerprints whose balls one task emits.
BALL_ROWS = 16_384
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, words_in_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles in their order, a bounded number at a time; none of a wordless text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_in_shingle + 1)
    last = ends[words_in_shingle - 1 :] if len(words) >= words_in_shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):  # bounds the memory that a very long text takes
        spans = zip(starts[at : at + _CHUNK].tolist()[: n - at], last[at : at + _CHUNK].tolist())
        yield np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], "<u8")


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text, unsigned.

    A-Z are lower-cased, words are what ASCII white space separates, shingles are joined by one space and count as
    often as they occur; a text with fewer words is one shingle. A bit is set if more than half of the shingles'
    XXH64 values have it. A null or wordless text has fingerprint zero.
    """
    n, counts = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, words_in_shingle):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(keyed: DataFrame, text: str, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``keyed`` other than ``text``, and ``fp`` (the fingerprint as a signed long)."""
    keys = [c for c in keyed.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            fps = [fingerprint(t.as_py(), words_in_shingle) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            columns.append(pa.array(np.array(fps, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fp"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name != text]
    return keyed.withColumn(text, F.col(text).cast("binary")).mapInArrow(run, ", ".join([*kinds, "fp long"]))


def ball(fp: Column, half_radius: int) -> Column:
    """All words within ``half_radius`` bits of ``fp``, itself first."""
    masks = [0]
    for flips in range(1, half_radius + 1):
        masks += [sum(1 << b for b in bits) for bits in itertools.combinations(range(BITS), flips)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m))


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links between different fingerprints of ``fps.fp`` that differ in at most ``radius`` bits.

    In the group of an emitted word, each fingerprint is linked to the next one. That is fewer links than pairs, but
    the same components: for any two fingerprints within the radius there is a word whose group holds both. Each
    distinct link is verified by counting its differing bits (in a group two words can be 2 * half the radius
    rounded up apart, so an odd radius needs it, and then all pairs of the group are looked at).
    """
    half = (radius + 1) // 2
    tasks = max(1, -(-fps.count() // BALL_ROWS))  # by rows: a fingerprint is few bytes, its ball is not
    emitted = fps.select("fp").repartition(tasks, "fp").distinct().select("fp", F.explode(ball(F.col("fp"), half)).alias("word"))
    order = Window.partitionBy("word").orderBy("fp")
    if radius == 2 * half:
        pairs = emitted.select(F.lag("fp").over(order).alias("a"), F.col("fp").alias("b"))
    else:  # a ball's group is bounded by the ball's size
        grouped = emitted.groupBy("word").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        pairs = grouped.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.where("a is not null").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``fp`` and ``component_id``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    id that links reach, itself included. Copies share a fingerprint, so they meet as one row of the fingerprint
    table; what is shuffled by fingerprint grows with different texts, not with pairs of copies.

    Null and wordless texts all have fingerprint zero and are linked. Repeated rows each return a row. A null id
    keeps its row; it is never the smallest unless all ids of the component are null. An empty table gives none.
    Other columns, of whatever name, are not looked at.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    marked = stage_table(with_fingerprints(keyed, "text", words_in_shingle), "fingerprints")
    least = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(near_links(least, radius), "a", "b")
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each ``unnamed, component`` of ``groups(doc_id, text_hash, unnamed, component)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = groups.groupBy("unnamed", "component").agg(first)
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")).distinct()
    hashed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    at = hashed[id_col].eqNullSafe(kept["kept_id"]) & (hashed["__text_hash"] == kept["kept_hash"])
    return hashed.join(kept, at, "left_semi").dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id (nulls last; of several rows
    with that id, the one with the least text hash, and of equal rows one). Columns are those of ``docs``, whatever their names."""
    return on_plain_names(docs, lambda table, at, text: _one_of_each(table, at, text, **options), id_col, text_col)


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, **options: int) -> DataFrame:
    groups = near_duplicate_groups(docs, id_col, text_col, **options)
    # two components of rows without any id must not be taken for one
    component = F.coalesce(F.col("component_id"), F.col("fp"))
    groups = groups.select("doc_id", "text_hash", F.col("component_id").isNull().alias("unnamed"), component.alias("component"))
    return _keep_first(docs, groups, id_col, text_col)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The different hashes of a text's shingles, for its similarity with others."""
    parts = list(shingle_hashes(text, CORPUS_SHINGLE_WORDS))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


_MIX = np.random.default_rng(HASH_SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_MIX[0] |= 1


def band_keys(hashes: np.ndarray) -> list[int]:
    """MinHash keys of a shingle set: each is the hash of its number and of ``BAND_ROWS`` minima."""
    if not len(hashes):
        return []
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (_MIX[0] * hashes[at : at + 2048] + _MIX[1]).min(1))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(low.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def parity_map(hashes: np.ndarray) -> list[int]:
    """``PARITY_LONGS`` longs: a bit is set if an odd number of a set's hashes fall on it.

    A hash that only one of two sets has changes one bit, so maps differ in at most as many bits as the sets do in members.
    """
    odd = np.bincount((hashes % (64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def with_keys(keyed: DataFrame) -> DataFrame:
    """``keyed(doc_id, text_hash, text)`` with the fingerprint ``fp``, the number ``n`` of shingles, ``keys`` and the parity map ``odd`` for ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, keys, odd = [], [], [], []
            for text in batch.column(2):
                text = text.as_py()
                own = shingle_set(text)
                fps.append(fingerprint(text))
                sizes.append(len(own))
                keys.append(band_keys(own))
                odd.append(parity_map(own))
            longs = pa.list_(pa.int64())
            columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(odd, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "fp", "n", "keys", "odd"])

    kind = dict(keyed.dtypes)["doc_id"]
    return keyed.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, n long, keys array<long>, odd array<long>")


def with_sets(texts: DataFrame) -> DataFrame:
    """``node, hashes`` of ``texts(node, text)``: their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, hashes array<long>")


def similar_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)``: verified links between similar texts, from ``nodes(node, least, n, keys, odd)`` and ``texts(node, text)``.

    In a round, the first texts of every key by their least id, its leaders, are compared with all texts of the key; what
    is neither a leader nor similar to one goes into the next round. So two texts that share a key are compared unless
    an earlier text has been found similar to one of them: of any two texts that are the first of their components,
    none with a common key is left uncompared. Texts similar to a leader leave a key, so
    its pairs grow with the square only of what shares it without being similar. Most of those the join drops at once:
    sets of similarity s differ in (1 - s) / (1 + s) of their sizes' sum, so parity maps that differ in more bits
    belong to no similar pair. What passes is verified on whole sets; no similar pair fails to pass.
    """
    turn = F.struct(F.col("least").isNull().alias("no_id"), "least", "node")
    rows = nodes.select("node", "n", turn.alias("turn"), F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
    rows = rows.join(shared, "key", "left_semi").join(nodes.select("node", "odd"), "node")
    rows = stage_table(rows, "similar-keys")
    asked = texts.join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = stage_table(with_sets(asked), "similar-sets")
    links, leading = None, LEADERS
    apart = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("odd_a")[k])) for k in range(PARITY_LONGS)), F.lit(0))
    while links is None or not rows.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("turn"))
        leaders = rows.withColumn("place", place).where(F.col("place") <= leading)
        renamed = [F.col(c).alias(d) for c, d in (("node", "a"), ("n", "n_a"), ("turn", "turn_a"), ("odd", "odd_a"))]
        leaders = stage_table(leaders.select("key", *renamed), "similar-leaders")
        may = (F.col("turn_a") < F.col("turn")) & (F.least("n", "n_a") / F.greatest("n", "n_a") >= SIMILARITY)
        may &= apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("n") + F.col("n_a")) + 1e-6
        close = rows.join(leaders, "key").where(may)
        close = stage_table(close.select("key", "a", F.col("node").alias("b"), "n_a", F.col("n").alias("n_b")), "similar-close")
        pairs = close.drop("key").distinct()
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)
        both = F.size(F.array_intersect("hashes_a", "hashes_b"))
        found = stage_table(pairs.where(both / (F.col("n_a") + F.col("n_b") - both) >= SIMILARITY).select("a", "b"), "similar-links")
        links, leading = found if links is None else links.union(found), 2 * leading
        others = rows.join(leaders.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
        done = close.join(found, ["a", "b"]).select("key", F.col("b").alias("node"))
        rows = stage_table(others.join(done, ["key", "node"], "left_anti"), "similar-keys")
    return links


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``keep_one_of_each`` picks it.

    Documents are linked if their sets of five-word shingles have a similarity of at least ``SIMILARITY``, or their
    fingerprints differ in at most ``RADIUS`` bits. Texts are nodes by their hash, so that copies meet as one row.
    """
    return on_plain_names(docs, _one_of_similar, id_col, text_col)


def _one_of_similar(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    marked = stage_table(with_keys(keyed), "similar-marked")
    nodes = marked.groupBy(F.col("text_hash").alias("node")).agg(
        F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("odd").alias("odd")
    )
    nodes = stage_table(nodes, "similar-nodes")
    fps = stage_table(nodes.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    same = nodes.join(fps, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = near_links(fps)
    for side in "ab":
        near = near.join(fps.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}")), side)
    near = near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    links = similar_links(nodes, keyed.select(F.col("text_hash").alias("node"), "text")).union(same).union(near)
    roots = connected_components(links, "a", "b")
    rooted = marked.select("doc_id", "text_hash").join(roots, F.col("text_hash") == F.col("node"), "left")
    groups = rooted.select("doc_id", "text_hash", F.lit(False).alias("unnamed"), F.coalesce("component", "text_hash").alias("component"))
    return _keep_first(docs, groups, id_col, text_col)
