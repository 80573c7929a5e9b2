"""Token ids in files of patched frame-of-reference blocks.

A file is a stream of ids in blocks of 128. A block stores its least id and the differences from it, packed at the width
that a percentile of them needs; the high bits of the others are exceptions, in a list of places and values. An index
holds where each block starts, so that a document is read by decoding the blocks it lies in. Tasks write files side by
side, each a range of document ids; a file's place in the whole stream follows from the table of files.

Layout of a file (little-endian): header, blocks, index (a record per block), documents (id, number of ids), null marks.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.session import shared_dir, stage_table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 128
#: Share of a block's differences that fit its width; the others are exceptions.
PERCENTILE = 0.95
#: Ids after which a task begins a new file; a document is never divided between files.
FILE_IDS = 1 << 24
#: Blocks that are packed at a time.
PACK_BLOCKS = 4096
#: Distinct chunks in a generation of those whose ids a Python worker keeps.
CACHE_CHUNKS = 700_000
SUFFIX = ".pfor"

MAGIC = b"PFOR0001"
#: Magic, task, file of the task, ids, documents, offset of the index (documents and null marks follow it).
HEADER = struct.Struct("<8sIIQQQ")
INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("exceptions", "u1")])
WORDS = BLOCK // 64


# -- ids of texts --------------------------------------------------------------------------------------------------

#: White space, and characters that some readings of it count in.
_SPACE = r"\s\u180e\u200b-\u200f\u2060\ufeff"
#: A blank that no other token than white space need begin with.
_JOINED = re.compile(f" (?=[{_SPACE}]|\\Z)")
_SPLIT = re.compile(f" (?=[^{_SPACE}])")

#: Plain letters (ASCII and Latin-1), and signs that are a token or more of their own behind them: ASCII's, but for the
#: apostrophe, which can begin a token with letters.
_LETTER, _SIGN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"([{_LETTER}]+)([{_SIGN}]*(?:\n[{_LETTER}]+[{_SIGN}]*)*)")
_PARTS = re.compile(f"[{_LETTER}]+|[{_SIGN}]+|\n")

_encoders: dict[str, ByteEncoder] = {}


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


BYTE_LETTERS = _byte_letters()


class ByteEncoder:
    """Token ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, for a byte-level tokenizer.

    A token may begin with a blank but never goes on past one that a character other than white space follows, so a
    text's ids are those of its chunks between such blanks, each with the blank before it. Chunks recur: known ones are
    kept in two generations, and what is still in use moves up. A word of plain letters goes to the model at once, and
    once for all that may stand behind it. A text with a special token's string is encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.number = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.packed = [int(k).to_bytes(int(self.number[-1]), "little") for k in range(self.tokenizer.get_vocab_size())]
        self.behind: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(token in text for token in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.number)
        first, *chunks = _SPLIT.split(text) if _JOINED.search(text) else text.split(" ")
        different = set(chunks)
        if len(self.known) + len(different) > CACHE_CHUNKS:
            self.known, self.old, self.behind, self.heads = {}, self.known, {}, {}
        new = different.difference(self.known)
        if new:
            self._learn(new)
        return np.frombuffer(self._head(first) + b"".join(map(self.known.__getitem__, chunks)), self.number)

    def _head(self, first: str) -> bytes:
        """The ids of a text's first chunk, before which there is no blank."""
        if first not in self.heads:
            ids = self.tokenizer.encode(first, add_special_tokens=False).ids if not _PLAIN.fullmatch(first) else None
            self.heads[first] = b"".join(map(self._part, _PARTS.findall(first))) if ids is None else np.array(ids, self.number).tobytes()
        return self.heads[first]

    def _part(self, part: str) -> bytes:
        """The ids of what is split from its surroundings before the model sees it."""
        if part.isascii() and part != "\n":
            part = part.replace(" ", BYTE_LETTERS[32])
        else:
            part = part.encode().decode("latin-1").translate(BYTE_LETTERS)
        found, packed = self.model.tokenize(part), self.packed
        return packed[found[0].id] if len(found) == 1 else b"".join([packed[t.id] for t in found])

    def _learn(self, new: set[str]) -> None:
        known, old, behind, unseen = self.known, self.old, self.behind, []
        for c in new:
            if c in old:
                known[c] = old[c]
                continue
            if c.isascii() and c.isalpha():
                word, rest = c, ""
            elif plain := _PLAIN.fullmatch(c):
                word, rest = plain.groups()
            else:
                unseen.append(c)
                continue
            if word not in known:
                known[word] = old[word] if word in old else self._part(f" {word}")
            if rest:
                if rest not in behind:
                    behind[rest] = b"".join(map(self._part, _PARTS.findall(rest)))
                known[c] = known[word] + behind[rest]
        for at in range(0, len(unseen), 10_000):
            part = unseen[at : at + 10_000]
            found = self.tokenizer.encode([f" {c}" for c in part], is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(found.ids, self.number), np.array(found.word_ids, np.int64)
            ends = (ids.itemsize * np.searchsorted(of, np.arange(len(part)), side="right")).tolist()
            known.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))


def encoder(path: str) -> ByteEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


# -- blocks ---------------------------------------------------------------------------------------------------------


def _lanes(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below ``2**width`` as rows of ``2 * width`` words: 64 values fill ``width`` words."""
    values = values.reshape(len(values), WORDS, 64).astype("<u8")
    words = np.zeros((len(values), WORDS, width), "<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[:, :, word] |= values[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= values[:, :, k] >> np.uint64(64 - shift)
    return words.reshape(len(values), WORDS * width)


def _values(words: np.ndarray, width: int) -> np.ndarray:
    """What ``_lanes`` packed."""
    words = words.reshape(len(words), WORDS, width)
    values = np.zeros((len(words), WORDS, 64), "<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        values[:, :, k] = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            values[:, :, k] |= words[:, :, word + 1] << np.uint64(64 - shift)
    return values.reshape(len(words), BLOCK) & np.uint64((1 << width) - 1)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """Blocks as bytes, and their index with starts from 0. The last block is filled up with its least id.

    A block is its packed low bits, then a byte per exception (its place) and four (its high bits). The first of a
    block's values at the percentile gives the width; at most 128 - ceil(128 * percentile) values need more.
    """
    count = -(-len(ids) // BLOCK)
    padded = np.zeros(count * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(count, BLOCK)
    if len(ids) % BLOCK:
        rows[-1, len(ids) % BLOCK :] = rows[-1, : len(ids) % BLOCK].min()
    least = rows.min(1) if count else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    place = int(np.ceil(BLOCK * percentile)) - 1
    width = np.frexp(np.partition(rest, place, 1)[:, place].astype(float))[1]
    over = rest >> np.minimum(width, 31)[:, None].astype(np.uint32) >> (width == 32)[:, None].astype(np.uint32)
    index = np.zeros(count, INDEX)
    index["least"], index["width"], index["exceptions"] = least, width, (over > 0).sum(1)
    out: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        of_width = np.flatnonzero(width == w)
        if w:
            packed = _lanes(rest[of_width] & np.uint32((1 << w) - 1), w)
            for block, row in zip(of_width.tolist(), packed):
                out[block] = row.tobytes()
    of_block, places = np.nonzero(over)
    high, places = over[of_block, places].astype("<u4").tobytes(), places.astype("u1").tobytes()
    at = 0
    for block, n in zip(*(x.tolist() for x in (np.flatnonzero(index["exceptions"]), index["exceptions"][index["exceptions"] > 0]))):
        out[block] += places[at : at + n] + high[4 * at : 4 * (at + n)]
        at += n
    sizes = np.fromiter(map(len, out), np.uint64, count)
    index["start"] = np.cumsum(sizes) - sizes
    return out, index


def unpack_blocks(data: bytes, index: np.ndarray) -> np.ndarray:
    """The ids of the blocks of ``index``, wherever in ``data`` they start."""
    raw = np.frombuffer(data, "u1")
    ids = np.zeros((len(index), BLOCK), np.uint32)
    start, width = index["start"].astype(np.int64), index["width"].astype(np.int64)
    for w in np.unique(width).tolist():
        of_width = np.flatnonzero(width == w)
        if w:
            taken = raw[start[of_width][:, None] + np.arange(8 * WORDS * w)]
            ids[of_width] = _values(taken.view("<u8"), w).astype(np.uint32)
    count = index["exceptions"].astype(np.int64)
    if count.any():
        block = np.repeat(np.arange(len(index)), count)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        at = start[block] + 8 * WORDS * width[block]
        high = raw[(at + count[block] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel()
        ids[block, raw[at + nth]] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return ids + index["least"][:, None]


# -- files ----------------------------------------------------------------------------------------------------------


class FileBuilder:
    """One file: ids go in, document after document, and are packed as blocks fill up."""

    def __init__(self, task: int, number: int, percentile: float = PERCENTILE):
        self.task, self.number, self.percentile = task, number, percentile
        self.blocks: list[bytes] = []
        self.index: list[np.ndarray] = []
        self.documents: list[tuple[int, int, bool]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, *end: int) -> None:
        """A document's ids, and one more behind them if asked for."""
        count = len(ids) + len(end)
        self.documents.append((doc_id or 0, count, doc_id is None))
        self.held += [ids, np.array(end, ids.dtype)] if end else [ids]
        self.n_held += count
        self.n_ids += count
        if self.n_held >= PACK_BLOCKS * BLOCK:
            self._pack(self.n_held // BLOCK * BLOCK)

    def _pack(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        blocks, index = pack_blocks(ids[:count], self.percentile)
        index["start"] += self.size
        self.blocks += blocks
        self.index.append(index)
        self.size += sum(map(len, blocks))
        self.held, self.n_held = [ids[count:]], len(ids) - count

    def content(self) -> bytes:
        self._pack(self.n_held)
        index = np.concatenate(self.index)
        index["start"] += HEADER.size
        documents = np.array([(d, n) for d, n, _ in self.documents], "<i8").tobytes()
        marks = np.packbits([null for _, _, null in self.documents]).tobytes()
        header = HEADER.pack(MAGIC, self.task, self.number, self.n_ids, len(self.documents), HEADER.size + self.size)
        return b"".join([header, *self.blocks, index.tobytes(), documents, marks])


class TokenFile:
    """A file's content: its documents, and ids by document, by range, or whole."""

    def __init__(self, data: bytes):
        magic, self.task, self.number, self.n_ids, n_docs, at = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        count = -(-self.n_ids // BLOCK)
        self.data = data
        self.index = np.frombuffer(data, INDEX, count, at)
        documents = np.frombuffer(data, "<i8", 2 * n_docs, at + count * INDEX.itemsize).reshape(n_docs, 2)
        nulls = np.unpackbits(np.frombuffer(data, "u1", offset=at + count * INDEX.itemsize + documents.nbytes), count=n_docs).astype(bool)
        self.doc_ids: list[int | None] = [None if null else d for d, null in zip(documents[:, 0].tolist(), nulls.tolist())]
        self.lengths = documents[:, 1]
        self.ends = np.cumsum(self.lengths)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``; no block but theirs is decoded."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        return unpack_blocks(self.data, self.index[first:last]).ravel()[start - first * BLOCK : end - first * BLOCK]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.ends[place] - self.lengths[place]), int(self.ends[place]))

    def documents(self) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
        """``(place, start in the file, id, ids)`` of all documents, decoding some thousands of blocks at a time."""
        place, starts = 0, self.ends - self.lengths
        while place < len(self.ends):
            upto = max(place + 1, int(np.searchsorted(self.ends, starts[place] + PACK_BLOCKS * BLOCK, side="right")))
            part = self.ids(int(starts[place]), int(self.ends[upto - 1]))
            for k in range(place, upto):
                yield k, int(starts[k]), self.doc_ids[k], part[starts[k] - starts[place] : self.ends[k] - starts[place]]
            place = upto


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``folder`` and its path there; a task writes with it whatever store Spark shares."""
    if re.match("file:/+", folder):
        folder = "/" + re.sub("^file:/+", "", folder)
    return pafs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, content: bytes, attempt: int) -> None:
    """A file appears under its name only when it is whole; a second attempt of a task puts the same one there."""
    store, path = _store(folder)
    draft = f"{path}/_{name}.{attempt}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, f"{path}/{name}")


FILES = "task int, file int, n_ids long, n_docs long, n_bytes long"


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    percentile: float = PERCENTILE, file_ids: int = FILE_IDS, end_id: int = END_ID,
) -> DataFrame:
    """Write the ids of all documents into ``folder`` in ascending order of ids, and return the table of files.

    ``task, file, n_ids, n_docs, n_bytes, start``: a file's first id is number ``start`` of the whole stream; the table is
    also kept in ``folder`` as Parquet. Documents are dealt by ranges of ids to tasks that tokenise and write. Null and
    empty texts are the end id alone; null ids come last; equal ids are ordered by a hash of the text, and one that
    many rows share is dealt to several tasks. Texts of any length are taken whole. Without rows no file is written.
    """
    path = vocabulary or public_tokenizers.path(TOKENIZER)
    store, place = _store(folder)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context, number, built = encoder(path), TaskContext.get(), 0, None

        def done(built: FileBuilder) -> pa.RecordBatch:
            content = built.content()
            _write(folder, f"part-{built.task:06d}-{built.number:06d}{SUFFIX}", content, context.taskAttemptId())
            values = (built.task, built.number, built.n_ids, len(built.documents), len(content))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in FILES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                built = built or FileBuilder(context.partitionId(), number, percentile)
                built.add(doc_id, encode(text.as_py()), end_id)
                if built.n_ids >= file_ids:
                    yield done(built)
                    built, number = None, number + 1
        if built:
            yield done(built)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = stage_table(ranged.mapInArrow(run, FILES), "token-files", batch_rows=500)
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("of_task"))  # a row per task that wrote, few enough for one window
    before = F.coalesce(F.sum("of_task").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("within", within).join(tasks.withColumn("before", before).drop("of_task"), "task")
    placed = placed.withColumn("start", F.col("before") + F.col("within")).drop("before", "within")
    placed.write.mode("overwrite").parquet(f"{folder}/_files")
    return docs.sparkSession.read.schema(placed.schema).parquet(f"{folder}/_files")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``folder``, and its ``ids`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["task", "file", "at", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())]
        for batch in batches:
            for content in batch.column(0):
                file, rows = TokenFile(content.as_py()), []
                for _, at, doc_id, ids in file.documents():
                    rows.append((file.task, file.number, at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids] * with_ids))
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    schema = "task int, file int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    starts = spark.read.parquet(f"{folder}/_files").select("task", "file", F.col("start").alias("first"))
    found = files.mapInArrow(run, schema).join(starts, ["task", "file"])
    return found.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from files that this writes into the shared folder."""
    folder = os.path.join(shared_dir(docs.sparkSession), f"token-ids-{uuid.uuid4().hex}")
    write_token_files(docs, folder, id_col, text_col, vocabulary)
    return read_token_files(docs.sparkSession, folder)
