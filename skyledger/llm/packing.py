"""Packing documents into token windows by best-fit decreasing.

A document longer than a window is first cut into full windows. What remains of each is placed, longest first, into
the tightest open window; a segment tree over remaining capacities finds it in log(window) steps. The pieces are dealt
round-robin to groups of bounded size that are packed side by side, so that no task holds more than a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from skyledger.session import stage_table

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Pieces in a group: a group's windows that stay open cost padding once per group.
GROUP_PIECES = 20_000
#: Distinct chunks in a generation of those whose ids a Python worker keeps.
CACHE_CHUNKS = 350_000

#: ASCII letters in lower case, and a line's end as a blank: what the tokenizer makes of them anyhow.
_LOWER_AND_BLANKS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
#: For texts with marks that a capital may be composed with before its case is lowered (U+0300 to U+037F).
_BLANKS = bytes(32 if c == 10 else c for c in range(256))

#: The last letter of a chunk, and a full stop or comma that is a token of its own behind it: an ASCII or Latin-1 letter
#: (whose lower case is one letter, and that no mark behind it can change).
_ENDED = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,]\Z")
#: Lower-case letters of ASCII and Latin-1 alone.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LATIN_1 = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, a chunk between blanks at a time.

    The tokenizer lowers case, drops white space and never joins what it separates, so a text's ids are those of its
    chunks in order, and chunks recur. A full stop or comma after a plain letter is a token of its own, so that a word
    is encoded once for all of its endings; words of plain letters go to the model at once. Known chunks are kept in
    two generations: when the young one is full, it becomes the old one, and what is still in use moves up. A text with a
    string of one of the tokenizer's special tokens is encoded as a whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # lowering a chunk's case must not make a special token of it
        self.number = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.in_model = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in _LATIN_1}
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The ids of a text, which is UTF-8."""
        text = text or b""
        if any(token in text for token in self.special):
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, self.number)
        chunks = text.translate(_BLANKS if b"\xcc" in text or b"\xcd" in text else _LOWER_AND_BLANKS).split(b" ")
        different = set(chunks)
        if len(self.known) + len(different) > CACHE_CHUNKS:
            self.known, self.old = {}, self.known
        new = different.difference(self.known)
        if new:
            self._learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), self.number)

    def _learn(self, new: set[bytes]) -> None:
        known, old = self.known, self.old
        ended = [c for c in new if c not in old and _ENDED.search(c)]
        words = new.difference(ended)
        words.update([c[:-1] for c in ended], (b".", b","))
        model, in_model, number, others = self.model.tokenize, self.in_model, self.number, []
        for c in words:
            if c in old:
                known[c] = old[c]
            elif c not in known:
                if _LETTERS.fullmatch(c):
                    known[c] = np.array([t.id for t in model(c.decode() if c.isascii() else c.decode().translate(in_model))], number).tobytes()
                else:
                    others.append(c)
        for at in range(0, len(others), 10_000):
            self._encode(others[at : at + 10_000])
        for c in ended:
            known[c] = known[c[:-1]] + known[c[-1:]]

    def _encode(self, chunks: list[bytes]) -> None:
        """Encode chunks in one call; the word numbers of its tokens tell whose they are."""
        found = self.tokenizer.encode([c.decode() for c in chunks], is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(found.ids, self.number), np.array(found.word_ids, np.int64)
        ends = (ids.itemsize * np.searchsorted(of, np.arange(len(chunks)), side="right")).tolist()
        self.known.update(zip(chunks, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(total: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``total`` ids: full windows, then what remains."""
    return [(at, min(window, total - at)) for at in range(0, total, window)]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenised_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, with_ids: bool = True
) -> DataFrame:
    """The pieces of every document: where it starts, its length, the CRC of its ids, and ``ids`` if asked for.

    A null or empty text is one piece, the end id alone. Texts are taken whole, however long.
    """
    path = vocabulary or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), END_ID).astype("<u4")
                for start, length in cut(len(ids), window):
                    own = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(own.tobytes()), len(ids), own if with_ids else None))
            columns = [list(c) for c in zip(*rows)] if rows else [[]] * 6
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[5], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return keyed.mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


class OpenWindows:
    """The open windows by remaining capacity, under a segment tree of how many there are below each node."""

    def __init__(self, window: int):
        self.size = 1 << (window).bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node, count = capacity + self.size, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, capacity: int, sequence: int, used: int) -> None:
        self.at[capacity].append((sequence, used))
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """The tightest open window with ``need`` left: its capacity, sequence and used length."""
        node, count = need + self.size, self.count
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        sequence, used = self.at[capacity].pop()
        self._add(capacity, -1)
        return capacity, sequence, used


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length, and the number of sequences. Equal lengths go in the order given."""
    windows, sequences = OpenWindows(window), 0
    sequence_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = windows.take(length)
        if found is None:
            found, sequences = (window, sequences, 0), sequences + 1
        capacity, sequence, used = found
        sequence_of[i], offset_of[i] = sequence, used
        if capacity > length:
            windows.put(capacity - length, sequence, used + length)
    return sequence_of, offset_of, sequences


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The columns of ``pieces`` and ``sequence_id``, ``offset``. No piece may be longer than ``window``.

    Pieces are dealt round-robin, whatever their documents, so groups are even and of about ``group_pieces``.
    Spark orders rows before dealing them, so a lost task's group comes out as before.
    """
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        sequence, offset, _ = best_fit_decreasing(table.column("length").to_numpy(), window)
        first = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(groups).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Where each piece of each document goes: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Token ids stay out of the shuffle: a piece's ids are known once its document is cut, so only its measures are
    packed. ``packed_sequences`` puts ids and places together. Documents are tokenised once, into a staged table.

    Null and empty texts are one id (the end id). Repeated rows are packed as often as they occur; a null id stays
    null. A document of any length is cut into full windows and a rest. An empty table gives an empty result. Other
    columns are ignored.
    """
    return pack(stage_table(tokenised_pieces(docs, id_col, text_col, window, vocabulary, with_ids=False), "pieces"), window)


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids`` (at most ``window`` ids) and ``doc_ids`` in order."""
    pieces = stage_table(tokenised_pieces(docs, id_col, text_col, window, vocabulary), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pack(pieces, window).groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
