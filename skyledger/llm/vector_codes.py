"""Compressing vectors to codes of a few bytes, with codebooks learnt in whole numbers.

A vector is cut into parts, and each part is coded as the nearest of its codebook's entries. Parts lie in flat blocks
in the order of a Hilbert curve, so that a block's parts are close to each other; a block stores its box (least and
greatest components) and its sum. In a round, distances from entries to boxes leave each block a short list of entries
that may be nearest to one of its parts; a list of one settles the whole block by its sum, and others are evaluated
exactly by a small kernel over the block. Rows stay where they are: only sums by entry leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.hard_negatives import LONG_MAX, usable, whole
from skyledger.session import small_batches, stage_table

BLOCK_ROWS = 64
#: Components of a chunk: rows that one task sorts and stores together (8 MB as longs).
CHUNK_VALUES = 1 << 20
#: Axes and bits of the curve; longer parts are averaged to so many axes.
AXES, BITS = 16, 4
#: Rows of staged chunks that a Python worker holds at a time.
BATCH_CHUNKS = 4


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on a Hilbert curve of points with coordinates below ``2**bits``; at most 64 bits in all."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # from coordinates to the transposed place: undo the turns of each level, then the Gray code
        below = level - 1
        for axis in range(axes):
            turned = (x[axis] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[axis] ^= swap
        level >>= 1
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << np.uint64(1)) | ((x[axis] >> bit) & 1).astype(np.uint64)
    return key


def curve_order(rows: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """An order of ``rows`` along the curve; cells are cut at quantiles of ``sample`` on each axis, or an average of neighbours.

    It decides how tight the blocks are, never a result.
    """
    if not rows.shape[1]:
        return np.arange(len(rows))
    starts = np.linspace(0, rows.shape[1], min(AXES, rows.shape[1]) + 1).astype(int)[:-1]
    axes, edges = (np.add.reduceat(x.astype(float), starts, 1) for x in (rows, sample))
    cuts = np.quantile(edges, np.arange(1, 1 << BITS) / (1 << BITS), axis=0)
    cells = np.stack([np.searchsorted(cuts[:, a], axes[:, a]) for a in range(axes.shape[1])], 1)
    return np.argsort(hilbert_keys(cells), kind="stable")


def _type_for(*arrays: np.ndarray) -> type:
    """Whole numbers in which sums of squared differences are exact: longs, or Python's own for very large ones."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    width = max(a.shape[-1] for a in arrays)
    return np.int64 if 4 * most * most * max(1, width) < 1 << 58 else object


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


class Blocks:
    """The sorted parts of a chunk at one position, in blocks with their boxes and sums."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray):
        self.rows, self.low, self.high, self.total = rows, low, high, total

    @classmethod
    def of(cls, rows: np.ndarray) -> Blocks:
        starts = np.arange(0, len(rows), BLOCK_ROWS)
        wide = rows.astype(object) if _type_for(rows) is object else rows
        total = np.stack([wide[s : s + BLOCK_ROWS].sum(0) for s in starts])
        return cls(rows, np.minimum.reduceat(rows, starts, 0), np.maximum.reduceat(rows, starts, 0), total)

    def short_lists(self, book: np.ndarray) -> np.ndarray:
        """For each block, which entries may be nearest to one of its parts: none else is, not even by a tie.

        An entry is out if even its nearest point of the box is farther than another entry's farthest point.
        """
        low, high, entries = self.low[:, None], self.high[:, None], book[None]
        least = _squares(np.maximum(np.maximum(low - entries, entries - high), 0))
        most = _squares(np.maximum(np.abs(entries - low), np.abs(high - entries)))
        return least <= most.min(1)[:, None]

    def nearest(self, book: np.ndarray, settle: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each part's entry (ties to the lower), its squared distance, and which blocks a list of one has settled.

        With ``settle``, distances of settled blocks are not worked out.
        """
        listed = self.short_lists(book)
        settled = listed.sum(1) == 1
        code, error = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), book.dtype)
        for block, entries in enumerate(listed):
            at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            own = np.flatnonzero(entries)
            if settled[block] and settle:
                code[at] = own[0]
                continue
            rows, listed_entries = self.rows[at], book[own]
            distance = _squares(rows)[:, None] - 2 * (rows @ listed_entries.T) + _squares(listed_entries)
            best = distance.argmin(1)
            code[at], error[at] = own[best], distance[np.arange(len(best)), best]
        return code, error, settled

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the parts nearest to each entry."""
        code, _, settled = self.nearest(book, settle=True)
        total = np.zeros(book.shape, book.dtype)
        first = np.arange(0, len(self.rows), BLOCK_ROWS)
        np.add.at(total, code[first[settled]], self.total[settled])
        single = ~np.repeat(settled, BLOCK_ROWS)[: len(self.rows)]
        np.add.at(total, code[single], self.rows[single])
        return np.bincount(code, minlength=len(book)), total


def _smallest(x: np.ndarray) -> np.ndarray:
    most = max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def chunk_record(rows: np.ndarray, samples: np.ndarray) -> dict:
    """A chunk as it is stored: ``places``, ``rows``, ``low``, ``high`` and ``total`` of all positions, flat, one after another."""
    orders = [curve_order(rows[:, p], samples[p]) for p in range(rows.shape[1])]
    blocks = [Blocks.of(rows[order, p]) for p, order in enumerate(orders)]
    flat = {name: _smallest(np.stack([getattr(b, name) for b in blocks])) for name in ("rows", "low", "high")}
    totals = np.stack([b.total for b in blocks])
    flat["total"] = np.zeros(0, "<i8") if totals.dtype == object else totals.astype("<i8")
    record = {name: x.tobytes() for name, x in flat.items()} | {f"{n}_bytes": flat[n].itemsize for n in ("rows", "low", "high")}
    return record | {"places": np.stack(orders).astype("<u4").tobytes()}


def read_chunk(record: dict, n: int, parts: int, width: int) -> tuple[np.ndarray, list[Blocks]]:
    """The stored order and blocks of each position; sums that no long may hold are taken anew."""
    count = -(-n // BLOCK_ROWS)
    read = lambda name, k: np.frombuffer(record[name], f"<i{record[f'{name}_bytes']}").astype(np.int64).reshape(parts, k, width)
    rows, low, high = read("rows", n), read("low", count), read("high", count)
    if record["total"] or not width:
        totals = np.frombuffer(record["total"], "<i8").reshape(parts, count, width)
        blocks = [Blocks(rows[p], low[p], high[p], totals[p]) for p in range(parts)]
    else:
        blocks = [Blocks.of(rows[p]) for p in range(parts)]
    return np.frombuffer(record["places"], "<u4").reshape(parts, n), blocks


def _in(kind: type, block: Blocks, book: np.ndarray) -> tuple[Blocks, np.ndarray]:
    return Blocks(*(x.astype(kind) for x in (block.rows, block.low, block.high, block.total))), book.astype(kind)


RECORD = ["rows", "low", "high", "total", "places"]
WIDTHS = ["rows_bytes", "low_bytes", "high_bytes"]


def _chunks(rows: DataFrame, samples: np.ndarray, parts: int, width: int) -> DataFrame:
    """``rows(id, label, v)`` as chunks, staged: ids and labels in the order of the rows, and their blocks."""
    per_chunk = max(BLOCK_ROWS, CHUNK_VALUES // (parts * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def chunk(table: pa.Table) -> pa.RecordBatch:
            v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, parts, width)
            record = chunk_record(v.astype(np.int64), samples)
            ends = pa.array([0, table.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in ("id", "label")]
            fixed = [pa.array([record[c]], pa.binary()) for c in RECORD] + [pa.array([record[c]], pa.int32()) for c in WIDTHS]
            return pa.RecordBatch.from_arrays([*lists, *fixed], names=["ids", "labels", *RECORD, *WIDTHS])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= per_chunk:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, per_chunk))
                held = table.slice(per_chunk).to_batches()
                count -= per_chunk
        if count:
            yield chunk(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [f"ids array<{kinds['id']}>", f"labels array<{kinds['label']}>", *(f"{c} binary" for c in RECORD), *(f"{c} int" for c in WIDTHS)]
    return stage_table(rows.mapInArrow(run, ", ".join(columns)), "vector-chunks", batch_rows=max(64, min(2_000, per_chunk)))


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    for k in range(batch.num_rows):
        yield len(batch.column("ids")[k]), {c: batch.column(c)[k].as_py() for c in RECORD + WIDTHS}


def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floor of its parts' mean; one without parts stays.

    A task gives a row per entry that it has parts for: number and sums, each as a high and a low half, so that sums of
    sums are exact. What reaches the driver is as large as the codebooks.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            for n, record in _records(batch):
                for p, block in enumerate(read_chunk(record, n, parts, width)[1]):
                    block, book = _in(_type_for(block.rows, books[p]), block, books[p])
                    of_chunk, sums = block.sums(book)
                    counts[p] += of_chunk
                    total[p] += sums.astype(object)
        p, e = np.nonzero(counts)
        values = np.concatenate([counts[p, e][:, None].astype(object), total[p, e]], 1)
        halves = [pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64())) for x in (values >> 32, values & 0xFFFFFFFF)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), *halves], names=["part", "entry", "high", "low"])

    of_tasks = chunks.mapInArrow(run, "part int, entry int, high array<long>, low array<long>")
    each = of_tasks.select("part", "entry", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    sums = each.groupBy("part", "entry", "at").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    with small_batches(chunks.sparkSession, BATCH_CHUNKS):
        found = sums.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "high", "low"))).alias("s")).collect()
    after = books.copy()
    for row in found:
        count, *values = [(s["high"] << 32) + s["low"] for s in row["s"]]
        after[row["part"], row["entry"]] = [v // count for v in values]
    return after


def _coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    parts, entries, width = books.shape
    digits = np.array([f"{e:02x}" for e in range(max(256, entries))], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (n, record) in enumerate(_records(batch)):
                code, error = np.full(n, "", object), np.zeros(n, object)
                for p, (order, block) in enumerate(zip(*read_chunk(record, n, parts, width))):
                    block, book = _in(_type_for(block.rows, books[p]), block, books[p])
                    nearest, distance, _ = block.nearest(book, settle=False)
                    code_p, error_p = np.empty(n, object), np.empty(n, object)
                    code_p[order], error_p[order] = digits[nearest], distance
                    code, error = code + code_p, error + error_p
                errors = pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())
                columns = [batch.column(c)[k].values for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), errors], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema if f.name in ("ids", "labels")}
    return chunks.mapInArrow(run, f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector.

    Components become ``floor(scale * x)``. A position's codebook starts as that part of the vectors with the ``entries``
    smallest ids; each round every part goes to its nearest entry (ties to the lower), and an entry becomes the floor
    of its parts' mean, or stays if it has none. ``error`` is the squared distance of the vector from its code's
    entries, ``label_error`` its sum over a label, nulls together.

    Rows whose vector is null or has a null or non-finite component are left out; those with a null id stay, and come
    after all others in the order of ids; equal ids are ordered by their whole numbers. Repeated rows are each coded. With
    fewer than ``entries`` rows, codebooks are so much shorter. Vectors shorter than the longest, or whose length the
    parts don't divide, are filled up with zeros. A component that no long can hold becomes the nearest long, an error
    or sum of errors likewise; sums and distances are exact at any size. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    rows = rows.withColumn("v", whole(F.col("v"), scale))
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v"))))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], object).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = start.astype(np.int64)
    chunks = _chunks(rows, books, parts, width)
    for _ in range(rounds if first else 0):
        books = _round(chunks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stage_table(_coded(chunks, books), "codes", batch_rows=BATCH_CHUNKS)
    most = F.lit(LONG_MAX).cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"))
    by_label = stage_table(by_label, "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
