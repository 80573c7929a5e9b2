"""Personal data: fixed patterns, and terms that give a protected entity away.

Entities that the patterns find are protected. Over the whole corpus, the words near them are counted, and how much
each tells about an entity is its pointwise mutual information with it, as a share of the entity's information
content. A term over a disclosure threshold is generalised, over a higher one removed, wherever it stands near that
entity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.columns import on_plain_names
from skyledger.session import stage_table

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
#: Terms are looked for within so many code points of an entity.
REACH = 60
#: Different contexts in which a term must stand near an entity; copies of a passage are one context.
SUPPORT = 2
GENERALISE, REMOVE = 0.7, 0.9
HELD_WORDS = 200_000
#: Documents of a batch that are turned into Python objects at a time.
SLICE_ROWS = 500

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from each ``@``: the local part is the run before it, so no place is tried twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _is_card(digits: str) -> bool:
    if not 14 <= len(digits) <= 19:
        return False
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches that pass their tests, in order of start and kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if _is_card(m[0].replace(" ", "").replace("-", "")):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _signed(data: str) -> int:
    value = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """``(entity, term, context, start, end)``: the words around each entity; entity, term and context as hashes.

    Words that touch an entity's span, or are cut by the reach, don't count.
    """
    out = []
    for start, kind, end in spans:
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        words = []
        for m in _WORD.finditer(text, low, high):
            whole = (m.start() > low or low == 0 or not text[low - 1].isalpha()) and (m.end() < high or high == len(text) or not text[high].isalpha())
            if whole and not any(a < m.end() and m.start() < b for a, _, b in spans):
                words.append((m[0].lower(), m.start(), m.end()))
        entity = _signed(f"{KINDS[kind]}:{text[start:end].lower()}")
        context = _signed(" ".join(w for w, _, _ in words))
        out += [(entity, _signed(w), context, a, b) for w, a, b in words]
    return out


SPAN = "array<struct<start:int,kind:int,end:int>>"
NEAR = "array<struct<entity:long,term:long,context:long,start:int,end:int>>"


def evidence(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One pass over all texts: a row per document with ``keep``, a row id ``uid``, its spans and the terms near them;
    and rows ``(term, docs)`` with each task's counts of documents that have a term. To be staged, so that row ids last.
    """
    keep = keep or []
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([(n, pa.int64()) for n in ("entity", "term", "context")] + [(n, pa.int32()) for n in ("start", "end")]))
    picked = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, counts, kinds = TaskContext.get().partitionId() << 33, Counter(), None
        names = [*[f"k_{c}" for c in keep], "uid", "spans", "near", "term", "docs"]

        def of_documents(columns: list[pa.Array], spans: list, nears: list) -> pa.RecordBatch:
            ids, none = pa.array(range(uid, uid + len(spans)), pa.int64()), pa.nulls(len(spans), pa.int64())
            return pa.RecordBatch.from_arrays([*columns, ids, pa.array(spans, span), pa.array(nears, near), none, none], names=names)

        def of_terms() -> Iterator[pa.RecordBatch]:
            words = list(counts.items())
            for at in range(0, len(words), 10_000):
                part = words[at : at + 10_000]
                empty = [pa.nulls(len(part), k) for k in [*kinds, pa.int64(), span, near]]
                numbers = [pa.array([_signed(w) for w, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())]
                yield pa.RecordBatch.from_arrays([*empty, *numbers], names=names)
            counts.clear()

        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, max(1, b.num_rows), SLICE_ROWS)):
            kinds = [c.type for c in batch.columns[:-1]]
            spans, nears = [], []
            for text in batch.column(len(keep)):
                text = text.as_py() or ""
                found = base_spans(text)
                spans.append(found)
                nears.append(near_terms(text, found))
                counts.update(set(_WORD.findall(text.lower())))
                if len(counts) > HELD_WORDS:
                    yield from of_terms()
            yield of_documents(list(batch.columns[:-1]), spans, nears)
            uid += len(spans)
        if kinds is not None:
            yield from of_terms()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema][:-1]
    return picked.mapInArrow(run, ", ".join([*kinds, "uid long", f"spans {SPAN}", f"near {NEAR}", "term long", "docs long"]))


def disclosing_terms(table: DataFrame) -> DataFrame:
    """``(entity, term, share)`` of the terms that disclose, from staged evidence.

    ``share`` is PMI over information content: log(n(e,t) N / (n(e) n(t))) / log(N / n(e)). All four count different contexts, so
    that copies of a passage change none: where a term (or any) stands near an entity, n(t) (or N) counts its different
    contexts there; every other document with the term (or at all) is a context of its own. Term counts are summed
    only for terms that stand near an entity often enough. Nothing is held per entity: pairs are keys of aggregates, so
    that no hot entity gathers rows.
    """
    docs = table.where("uid is not null")
    near = docs.select("uid", F.explode("near").alias("x")).select("uid", "x.entity", "x.term", "x.context")
    rows = near.select("entity", "term", "context").distinct()
    pairs = stage_table(rows.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT), "pii-pairs")
    entities = stage_table(rows.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("contexts")), "pii-entities")
    wanted = stage_table(pairs.select("term").distinct(), "pii-terms")
    beside = near.join(wanted, "term", "left_semi").groupBy("term").agg(F.count_distinct("uid").alias("near_docs"), F.count_distinct("context").alias("near_contexts"))
    counted = table.where("uid is null").select("term", "docs").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("docs"))
    counted = counted.join(beside, "term").select("term", (F.col("docs") - F.col("near_docs") + F.col("near_contexts")).alias("n"))
    others = docs.where(F.size("near") == 0).count()
    total = F.lit(max(2, others + (entities.agg(F.sum("contexts")).first()[0] or 0))).cast("double")
    information = F.log(total / F.col("contexts"))
    share = F.log(F.col("both") * total / (F.col("contexts") * F.col("n"))) / information
    joined = pairs.join(entities, "entity").join(counted, "term").where(information > 0)
    return joined.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def with_terms(table: DataFrame) -> DataFrame:
    """The documents of staged evidence with ``spans`` completed by terms, and ``removed``: where terms are removed.

    A document's terms find their pair by (entity, term), a unique key on the other side.
    """
    disclosing = stage_table(disclosing_terms(table), "pii-disclosing")
    docs = table.where("uid is not null").drop("term", "docs")
    near = docs.where(F.size("near") > 0).select("uid", F.explode("near").alias("x")).select("uid", "x.entity", "x.term", "x.start", "x.end")
    hit = near.join(disclosing, ["entity", "term"]).groupBy("uid", "start", "end").agg(F.max("share").alias("share"))
    span = F.struct(F.col("start"), F.lit(TERM).alias("kind"), F.col("end"))
    added = hit.groupBy("uid").agg(
        F.collect_list(span).alias("added"), F.collect_list(F.when(F.col("share") >= REMOVE, F.col("start"))).alias("removed")
    )
    added = stage_table(added, "pii-added")
    whole = docs.join(added, "uid", "left")
    none = F.array().cast("array<int>")
    return whole.withColumns({
        "base": F.col("spans"), "removed": F.coalesce("removed", none),
        "spans": F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(SPAN)))),
    }).drop("near", "added")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans, removed`` of every row; spans are ``(start, kind, end)`` in code points, end exclusive.

    A null text is empty and has none. Repeated rows each return a row and count as documents each, but as one
    context. Texts of any length are searched whole, in time linear in it. A null id stays null; an empty table gives
    none. Other columns are not looked at.
    """
    return with_terms(stage_table(evidence(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"]), "pii-evidence")).select(
        F.col("k_doc_id").alias("doc_id"), "base", "spans", "removed"
    )


def sanitised_text(text: str, spans: list[tuple[int, int, int]], removed: set[int]) -> str:
    """The text with every span replaced: entities by their kind, generalised terms by a word for their form."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out.append(text[at:start])
            if kind != TERM:
                out.append(f"[{KINDS[kind].upper()}]")
            elif start not in removed:
                out.append("[NAME]" if text[start].isupper() else "[WORD]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and all other columns as they are, whatever their names.

    Overlapping spans are replaced as one, by the kind of the first. A null text stays null.
    """
    return on_plain_names(docs, _sanitised, text_col)


def _sanitised(docs: DataFrame, text_col: str) -> DataFrame:
    columns = docs.columns
    found = with_terms(stage_table(evidence(docs, text_col, keep=columns), "pii-evidence"))
    picked = found.select(*[F.col(f"k_{c}").alias(c) for c in columns], "spans", "removed")
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            texts = batch.column(place).to_pylist()
            spans, removed = batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()
            for i, own in enumerate(spans):
                if own:
                    texts[i] = sanitised_text(texts[i], [(s["start"], s["kind"], s["end"]) for s in own], set(removed[i]))
            kept = [*batch.columns[: len(columns)]]
            kept[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    return picked.mapInArrow(run, docs.schema)
