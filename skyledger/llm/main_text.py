"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: containers, each told apart by the way that leads to it (tags, names and its number among
siblings alike), and the texts in them. Over the pages of a host, a token has an occurrence vector: how often it is on
each page. Tokens with the same vector that are on most pages form an equivalence class; classes are valid if their
tokens nest, and together they are the host's template. What stands between template tokens are its slots. The main slot
is found by how much its length changes from page to page, and its content, without texts that are template themselves,
is extracted from each page. No name says what the main text is; names only settle which of several like slots goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import stage_table

#: A class is valid from this share of a host's pages on.
MOST = 0.5
#: A host's figures are averaged with so many pages that are like those of all hosts, and no text is on any of them.
PRIOR_PAGES = 4
#: A length that is always the same counts as if it changed by this share of it.
STEADY = 0.2
#: A container is like content if its length changes by this share of what the length around it changes by.
LIKE = 0.15
#: The search goes on inside the only container like content if it has this share of the change.
INSIDE = 0.5
ROOT = 0
ALL_HOSTS = "*"

# Fixed values of HTML.
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure "
    "fieldset details dialog center".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
#: Elements that are not part of the text they stand in, by their definition.
BESIDE = frozenset("nav aside footer form dialog".split())
#: What an opening tag closes if it is open in the same table.
IMPLIED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("thead", "tbody", "tr")}
#: Words in a class, id or role by which one of several slots that are alike otherwise is not the article.
TIE_WORDS = frozenset("ad ads advert comment comments reply replies menu nav sidebar related share notice cookie".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A run of text: the containers around it, outermost first, each as ``(path, parent, tag, tied)``."""

    around: tuple[tuple[int, int, str, bool], ...]
    text: str


@dataclass
class Page:
    """Container tokens in order of the page, and its blocks of text."""

    tokens: list[tuple[int, int, str, bool]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _key(data: str) -> int:
    return xxhash.xxh64_intdigest(data.encode("utf-8", "replace")) >> 1


def text_token(block: Block) -> int:
    """The key of a block's text in its container."""
    return _key(f"{block.around[-1][0] if block.around else ROOT}#{block.text}")


def parse(source: str) -> Page:
    """Tokens and blocks of a page. Unclosed and stray tags are taken as browsers do: a closing tag closes what is
    open inside it, one without its opening tag is nothing. Script-like elements and comments have no text.

    A container's path is a hash of its parent's path, its tag with its class and id (if they hold no digit) and its
    number among its siblings of that kind, so it is as short at any depth.
    """
    page, open_tags, parts, at = Page(), [], [], 0
    numbers: list[dict[str, int]] = [{}]  # by open container, and for the whole page
    stop = source.rfind(">") + 1  # behind it no tag is closed

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                page.blocks.append(Block(tuple(open_tags), text))

    def close_from(k: int) -> None:
        del open_tags[k:]
        del numbers[k + 1 :]

    while m := _TOKEN.search(source, at, stop):
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(source)
            continue
        name, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if name in RAW and not closing:
            if not rest.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
            if name not in INLINE:
                end_block()
            continue
        if name in INLINE:
            continue
        end_block()
        if name not in CONTAINERS:
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][2] == name:
                    close_from(k)
                    break
        elif not (rest.endswith("/") or name in VOID):
            if name in IMPLIED:
                table = max((k for k, tag in enumerate(open_tags) if tag[2] == "table"), default=-1)
                close_from(next((k for k in range(table + 1, len(open_tags)) if open_tags[k][2] in IMPLIED[name]), len(open_tags)))
            named = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _NAMED.findall(rest)]
            label = name + "".join(f".{v}" for k, v in named if k != "role" and not any(map(str.isdigit, v)))
            number = numbers[-1][label] = numbers[-1].get(label, 0) + 1
            parent = open_tags[-1][0] if open_tags else ROOT
            tied = name in BESIDE or any(w in TIE_WORDS for _, v in named for w in _PART.findall(v))
            open_tags.append((_key(f"{parent}/{label}/{number}"), parent, name, tied))
            numbers.append({})
            page.tokens.append(open_tags[-1])
    parts.append(source[at:].partition("<!--")[0])
    end_block()
    return page


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKEN_ROW = "host string, path long, parent long, text boolean, tied boolean, pages long, hits long, vector_a long, vector_b long, chars double, squares double, low long, high long"
_TOKEN_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def count_tokens(pages: DataFrame) -> DataFrame:
    """Token counts of ``pages(page_key, host, html)``, by host and, for containers, for all hosts together.

    An occurrence vector is held as two sums of 31-bit hashes of (page, count) over the pages: equal vectors have equal
    sums whatever the order, and tasks' partial sums combine, so that a host of any number of pages never meets in one
    place. ``chars`` and ``squares`` are the sums of a container's length in code points and of its square, ``low`` and
    ``high`` the least and greatest digest of its content, equal if it never changes; the whole page is the container
    ``ROOT``.
    """
    names = [x.split()[0] for x in TOKEN_ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}

        def add(host: str, path: int, parent: int, text: bool, tied: bool, hits: int, key: str, chars: int, digest: int) -> None:
            vector = xxhash.xxh64_intdigest(f"{key}:{hits}".encode())
            own = sums.setdefault((host, path), [parent, text, tied, 0, 0, 0, 0, 0.0, 0.0, digest, digest])
            for k, more in ((3, 1), (4, hits), (5, vector >> 33), (6, vector & 0x7FFFFFFF), (7, chars), (8, chars * chars)):
                own[k] += more
            own[9], own[10] = min(own[9], digest), max(own[10], digest)

        for batch in batches:
            for key, host, source in zip(*(c.to_pylist() for c in batch.columns)):
                page = parse(source or "")
                chars: dict[int, int] = {}
                digests: dict[int, int] = {}
                said: dict[tuple[int, int], int] = {}
                for block in page.blocks:
                    size, digest = len(block.text), _key(block.text)
                    for path in (ROOT, *[around[0] for around in block.around]):
                        chars[path] = chars.get(path, 0) + size
                        digests[path] = (digests.get(path, 0) + digest) & 0x7FFFFFFFFFFFFFFF
                    token = (text_token(block), block.around[-1][0] if block.around else ROOT)
                    said[token] = said.get(token, 0) + 1
                for (token, parent), hits in said.items():
                    add(host, token, parent, True, False, hits, key, 0, 0)
                for path, parent, _, tied in [(ROOT, -1, "", False), *page.tokens]:
                    for name in (host, ALL_HOSTS):
                        add(name, path, parent, False, tied, 1, key, chars.get(path, 0), digests.get(path, 0))
                if len(sums) > 50_000:
                    yield from rows(sums)
        yield from rows(sums)

    def rows(sums: dict[tuple[str, int], list]) -> Iterator[pa.RecordBatch]:
        found = [(host, path, *own) for (host, path), own in sums.items()]
        sums.clear()
        for at in range(0, len(found), 10_000):
            columns = zip(*found[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TOKEN_KINDS)], names=names)

    counted = pages.select("page_key", "host", "html").mapInArrow(run, TOKEN_ROW)
    return counted.groupBy("host", "path", "parent", "text").agg(
        F.max("tied").alias("tied"), *[F.sum(x).alias(x) for x in ("pages", "hits", "vector_a", "vector_b", "chars", "squares")],
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


Tokens = list[dict]


def main_slot(tokens: Tokens) -> tuple[int, list[int]]:
    """The main slot of a template and the template's containers that are not part of it.

    ``tokens`` are the containers of valid classes, each with its path, its parent and how much its length changes. From the whole page
    inwards: if one container alone is like content, and most of what changes is in it, the search goes on there. If
    there are several, they are the slot's content together, those with telling names left out (unless all have
    them), and the other containers beside them are not. If none is, the text stands in the slot itself.
    """
    inside: dict[int, Tokens] = {}
    for t in sorted(tokens, key=lambda t: t["path"]):
        inside.setdefault(t["parent"], []).append(t)
    here, change, beside = ROOT, next((t["change"] for t in tokens if t["path"] == ROOT), 0.0), []
    while True:
        own = inside.get(here, [])
        like = [t for t in own if t["change"] > 0 and t["change"] >= LIKE * change]
        if len(like) > 1 and not all(t["tied"] for t in like):
            like = [t for t in like if not t["tied"]]
        only = like[0] if len(like) == 1 and like[0]["change"] >= INSIDE * change else None
        if only or len(like) > 1:
            beside += [t["path"] for t in own if not any(t is x for x in like)]
        if not only:
            return here, beside
        here, change = only["path"], only["change"]


def templates(tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """``(host, slot, beside, texts)``: each host's main slot, the containers that are not part of it, and the texts of its template.

    Classes are tokens of one host with one vector. A class counts if it is on most pages, and if its tokens nest: each
    is once on every page that has the class, under a parent of the template or at the top. A text is template if it
    has the vector of a valid class: it is on just the pages that the class is on, once on each. A length's mean and variance
    are those of the host's pages and ``PRIOR_PAGES`` more that are like all hosts' pages, so a host of one page has a
    template too. Content that is the same on all of a container's pages counts as that of one of them.

    What meets by host is the template alone, which is no longer than a page.
    """
    own, everywhere = tokens.where(F.col("host") != ALL_HOSTS), tokens.where((F.col("host") == ALL_HOSTS) & ~F.col("text"))
    pages_of_all = totals.where(F.col("host") == ALL_HOSTS).select(F.col("n").alias("n_all"))
    usual = everywhere.crossJoin(F.broadcast(pages_of_all)).select("path", (F.col("chars") / F.col("n_all")).alias("mean"), (F.col("squares") / F.col("n_all")).alias("square"))
    enough = F.when(F.col("text"), F.col("pages") >= MOST * (F.col("n") + PRIOR_PAGES)).otherwise(F.col("pages") >= MOST * F.col("n"))
    known = own.join(totals, "host").where(enough & (F.col("hits") == F.col("pages")))
    of = lambda total, prior: (F.col(total) + PRIOR_PAGES * F.coalesce(prior, F.lit(0.0))) / (F.col("n") + PRIOR_PAGES)
    known = known.join(usual, "path", "left").withColumns({"m": of("chars", "mean"), "s": of("squares", "square")})
    variance = F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))
    once = F.when(F.col("low") == F.col("high"), 1 / F.col("pages")).otherwise(1.0)
    known = known.withColumn("change", once * F.sqrt(variance + F.pow(STEADY * F.col("m"), F.lit(2))))
    container = F.when(~F.col("text"), F.struct("path", "parent", "tied", "change"))
    words = F.when(F.col("text"), F.struct("path", "parent"))
    classes = known.groupBy("host", "vector_a", "vector_b", "pages").agg(F.collect_list(container).alias("own"), F.collect_list(words).alias("texts"))
    classes = classes.where(F.size("own") > 0)  # texts without a container of their class are no template
    flat = classes.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("texts")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                nested, inside = {-1}, {}
                for t in own:
                    inside.setdefault(t["parent"], []).append(t["path"])
                reach = [-1]
                while reach:
                    reach = [p for at in reach for p in inside.get(at, ())]
                    nested.update(reach)
                slot, beside = main_slot([t for t in own if t["path"] in nested])
                found.append((slot, beside, [t["path"] for t in texts if t["parent"] in nested]))
            columns = list(zip(*found)) if found else [[], [], []]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["host", "slot", "beside", "texts"])

    return flat.mapInArrow(run, "host string, slot long, beside array<long>, texts array<long>")


def slot_text(page: Page, slot: int = ROOT, beside: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
    """The page's blocks in its main slot without what the template says is beside it, without elements that are not
    text of what they stand in, and without the template's ``texts`` unless nothing else is in the slot (pages that
    are copies of each other).

    A page without the slot (another layout than most of its host's) has all its blocks but those beside.
    """
    has = slot != ROOT and any(path == slot for path, _, _, _ in page.tokens)
    picked = []
    for block in page.blocks:
        inside, out = not has, False
        for path, _, tag, _ in block.around:
            inside = inside or path == slot
            out = out or path in beside or (tag in BESIDE and path != slot)
        if inside and not out:
            picked.append(block)
    own = [b for b in picked if text_token(b) not in texts] if texts else picked
    return "\n".join(b.text for b in own or picked)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row.

    Blocks are what block tags and line breaks part; each has its character references decoded and its white space
    turned into single blanks, and is kept whole. A null or empty page has an empty text. Pages without a host in
    their URL are a host together. Repeated rows each return a row. Whole pages are used, however long. An empty table
    gives none. Other columns are not looked at.

    Templates meet pages in a join by host; a hot host is a skewed side of it, which adaptive execution splits.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    keyed = named.select(F.coalesce(F.col("page_id").cast("string"), F.col("url")).alias("page_key"), "host", "html")
    # a text on fewer pages is no template on any host
    tokens = count_tokens(keyed).where(~F.col("text") | (F.col("pages") > MOST * PRIOR_PAGES))
    tokens = stage_table(tokens, "page-tokens")
    totals = named.groupBy("host").agg(F.count("*").alias("n"))
    totals = stage_table(totals.union(named.agg(F.lit(ALL_HOSTS).alias("host"), F.count("*").alias("n"))), "page-hosts")
    found = stage_table(templates(tokens, totals), "page-templates").withColumnRenamed("host", "__host")
    joined = named.join(found, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "slot", "beside", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                slot_text(parse(source.as_py() or ""), slot.as_py() or ROOT, frozenset(beside.as_py() or ()), frozenset(said.as_py() or ()))
                for source, slot, beside, said in zip(*batch.columns[2:])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
