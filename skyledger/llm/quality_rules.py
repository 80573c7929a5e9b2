"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document is measured in one pass. Counts become odds (smoothed by half a unit, so that a long text without a symbol
tells more than a short one), and for each language and source a mergeable sketch of each measure (counts per logarithmic
bucket, which add up in any order) gives its quantiles among the documents that pass the base rules. A limit is a fence in
logarithms, as far above the upper quantile as the group's own spread says; there is no fixed cutoff. A join brings each
document its group's limits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.columns import on_plain_names
from skyledger.session import stage_table

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What is limited from above. ``long`` and ``short`` are the mean word length and its inverse: fences on both sides.
RATIOS = ("symbols", "dup_lines", "repeats", "long", "short")
#: A bucket's upper end is this many times its lower end: quantiles are right within 1 percent.
GROWTH = 1.01
#: A group's limit and that of the group around it are averaged by rows, the latter counting as so many.
PRIOR_ROWS = 50
#: A limit is the upper quantile plus so many times its distance from the median, all in buckets, that is in logarithms.
UPPER, SPREADS = 0.75, 5.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null or blank."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def word_count(text: Column) -> Column:
    """The number of words of a text as a long, 0 if it is null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def _covered(starts: Column) -> Column:
    """How many positions windows of three words cover that begin at ``starts``."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))


def _in_repeated(hashes: Column) -> Column:
    def few(repeated: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i))
        return _covered(F.filter(marked, lambda p: p.isNotNull()))

    def many(_: Column) -> Column:  # sorting keeps it n log n however many windows repeat
        def neighbours(order: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(order, a)["h"] == F.get(order, b)["h"], F.lit(False))
            kept = F.filter(F.transform(order, lambda s, i: F.when(same(i, i - 1) | same(i, i + 1), s["i"])), lambda p: p.isNotNull())
            return _covered(kept)

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)

    def by_order(order: Column) -> Column:
        again = F.array_distinct(F.filter(order, lambda h, i: (i > 0) & (h == F.get(order, i - 1))))
        return let(again, lambda r: F.when(F.size(r) == 0, 0).when(F.size(r) <= 24, few(r)).otherwise(many(r)))

    return let(F.sort_array(hashes), by_order)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Windows are told apart by 64-bit hashes of their three words.
    """
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n < 4, 0).otherwise(let(hashes, _in_repeated)).cast("long")


def measures(text: Column) -> Column:
    """A struct of ``MEASURES`` as longs."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    by_words = let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        ),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long")
    return F.struct(by_words.alias("words"), by_lines.alias("lines"), symbols.alias("n_symbols"))


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with a column for each of ``MEASURES``, their names preceded by ``prefix``, and ``base_failed``."""
    out = docs.withColumn("__m", measures(F.col(text_col)))
    found = {
        "n_words": "__m.words.n_words", "word_chars": "__m.words.word_chars", "n_repeat_words": "__m.words.n_repeat_words",
        "n_lines": "__m.lines.n_lines", "n_dup_lines": "__m.lines.n_dup_lines", "n_symbols": "__m.n_symbols",
    }
    out = out.withColumns({prefix + name: F.col(at) for name, at in found.items()}).drop("__m")
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.withColumn(f"{prefix}base_failed", (words < 50) | (100 * repeats > 50 * words))


def buckets(prefix: str = "") -> dict[str, Column]:
    """The logarithmic bucket of each of ``RATIOS`` of a measured row; to be asked of rows that pass the base rules."""
    of = lambda name: F.col(prefix + name)
    odds = lambda a, b: (of(a) + 0.5) / (F.greatest(of(b) - of(a), F.lit(0)) + 0.5)
    values = {
        "symbols": odds("n_symbols", "word_chars"), "dup_lines": odds("n_dup_lines", "n_lines"), "repeats": odds("n_repeat_words", "n_words"),
        "long": of("word_chars") / of("n_words"), "short": of("n_words") / of("word_chars"),
    }
    return {name: F.ceil(F.log(x) / F.log(F.lit(GROWTH))).cast("int") for name, x in values.items()}


def sketches(table: DataFrame, groups: list[str], prefix: str = "") -> DataFrame:
    """``(*groups, ratio, bucket, n)``: the mergeable sketch of the rows that pass the base rules."""
    each = F.array(*[F.struct(F.lit(name).alias("ratio"), x.alias("bucket")) for name, x in buckets(prefix).items()])
    rows = table.where(~F.col(f"{prefix}base_failed")).select(*groups, F.explode(each).alias("s"))
    return rows.groupBy(*groups, "s.ratio", "s.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """``(*groups, ratio, rows, fence)``: the size and the limit of merged sketches, by a group's few buckets."""
    merged = sketch.groupBy(*groups, "ratio", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*groups, "ratio")
    upto = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(own)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    return ranked.groupBy(*groups, "ratio").agg(F.first("rows").alias("rows"), (at(UPPER) + SPREADS * (at(UPPER) - at(0.5))).alias("fence"))


def limits(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """``(limit_lang, limit_source, limit_*)``: each group's limits, drawn towards its language's, and those towards all rows'.

    A group of few rows so has nearly its language's limits, and none needs a least size.
    """
    drawn = lambda own, around: (F.col("rows") * F.col(own) + PRIOR_ROWS * F.col(around)) / (F.col("rows") + PRIOR_ROWS)
    whole = fences(sketch, []).select(F.col("ratio").alias("__ratio"), F.col("fence").alias("all_fence"))
    by_lang = fences(sketch, [lang]).join(whole, F.col("ratio") == F.col("__ratio"))
    by_lang = by_lang.select(F.col(lang).alias("__lang"), F.col("ratio").alias("__ratio"), drawn("fence", "all_fence").alias("lang_fence"))
    own = fences(sketch, [lang, source])
    joined = own.join(by_lang, own[lang].eqNullSafe(by_lang["__lang"]) & (own["ratio"] == by_lang["__ratio"]))
    named = joined.select(F.col(lang).alias("limit_lang"), F.col(source).alias("limit_source"), "ratio", drawn("fence", "lang_fence").alias("limit"))
    by = [F.max(F.when(F.col("ratio") == name, F.col("limit"))).alias(f"limit_{name}") for name in RATIOS]
    return named.groupBy("limit_lang", "limit_source").agg(*by)


def judged(table: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """A measured and staged table with ``kept``: false if the base rules fail or a measure is over its group's limit.

    The limits are a row per language and source, staged so that Spark knows their size and broadcasts them only if
    they are small; otherwise a hot source is a skewed join side, which adaptive execution splits.
    """
    found = stage_table(limits(sketches(table, [lang, source], prefix), lang, source), "quality-limits")
    over = F.lit(False)
    for name, bucket in buckets(prefix).items():
        over = over | (bucket > F.col(f"limit_{name}"))
    at = table[lang].eqNullSafe(found["limit_lang"]) & table[source].eqNullSafe(found["limit_source"])
    joined = table.join(found, at, "left").withColumn("kept", ~F.col(f"{prefix}base_failed") & ~F.coalesce(over, F.lit(False)))
    return joined.drop("limit_lang", "limit_source", *[f"limit_{name}" for name in RATIOS])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` of every row.

    A null text has no words, so the base rules fail it, as they fail every text under 50 words. Null languages and
    sources are groups of their own. Repeated rows count each time and each return a row; null ids stay null. An
    empty table gives none. Other columns are not looked at.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return judged(stage_table(measured(keyed).drop("text"), "quality-measures"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``, whatever their names."""

    def kept(table: DataFrame, text: str, lang: str, source: str) -> DataFrame:
        return judged(stage_table(measured(table, text, "__q_"), "quality-measured"), lang, source, "__q_").where("kept")

    return on_plain_names(docs, kept, text_col, lang_col, source_col)
