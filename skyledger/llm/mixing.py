"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source is to give a number of words. Among all document rates between 0 and 2 that give it, those of greatest
entropy are exponentially tilted in the document's size: ``rate = 2 / (1 + exp(-tilt * size / mean size))``. The tilt
of each source is the minimum of a convex dual, which Newton steps over all documents find. Rates are then rounded
into whole copies so that the words still add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.columns import on_plain_names
from skyledger.llm.quality_rules import word_count
from skyledger.session import stage_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
TOLERANCE = 1e-7
MAX_STEPS = 60
#: Documents that are rounded together, about.
BLOCK_ROWS = 1_000


def unit_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, n)``: different documents and how many rows each has."""
    size = word_count(F.col(text_col)).alias("size")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size)
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point of ``source``, null last: ranges of sources are numbered side by side,
    and only the number of sources in each range goes through one window."""
    order = F.col("source").asc_nulls_last()
    ranged = stage_table(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("range").alias("__range"), F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    joined = ranged.withColumn("place", place).join(starts, F.col("range") == F.col("__range"))
    return joined.withColumn("rank", F.col("start") + F.col("place")).drop("range", "__range", "place", "start")


def source_targets(by_size: DataFrame) -> DataFrame:
    """``(source, source_size, docs, units, target)`` from ``by_size(source, size, docs, units)``.

    A source is at its limit if its weight times the level exceeds it; the level is what is left beside the full ones,
    by weight. It only rises from round to round, and so does the number of full sources. A round is one aggregate of
    two sums over the sources.
    """
    totals = by_size.groupBy("source").agg(
        F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"), F.sum("units").alias("units")
    )
    weight = reduce(lambda c, kw: c.when(F.col("rank") % len(WEIGHTS) == kw[0], float(kw[1])), enumerate(WEIGHTS), F.when(F.lit(False), 0.0))
    limited = numbered(totals).withColumn("weight", weight).withColumn("limit", MOST_COPIES * F.col("source_size").cast("double"))
    limited = stage_table(limited, "mix-limits")
    everything, level, risen = SHARE * (limited.agg(F.sum("source_size")).first()[0] or 0), -1.0, 0.0
    while risen != level:
        level = risen
        full = F.col("limit") <= F.col("weight") * level
        used, open_weight = limited.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        risen = (everything - (used or 0.0)) / open_weight if open_weight else level
    target = F.least("limit", F.col("weight") * level)
    return limited.select("source", "source_size", "docs", "units", target.alias("target"))


def tilted(tilt: Column, size: Column, mean: Column) -> Column:
    """The rate of a document of ``size`` words in a source of that tilt."""
    return MOST_COPIES / (1 + F.exp(-F.least(F.greatest(tilt * size / mean, F.lit(-500.0)), F.lit(500.0))))


def balance(by_size: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``mean`` and ``tilt``: each source's minimum of the dual.

    A Newton step is one aggregation over all documents (told apart by source and size only, which is all that a rate
    depends on) for all sources at once. A step that leaves the bracket of signs seen so far is replaced by its
    middle. Tilts are rounded, so that the order in which sums are added up leaves no trace. A source at its limit needs no tilt: all its
    documents go twice. Only the largest deviation reaches the driver.
    """
    state = targets.withColumns({
        "mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)), "tilt": F.lit(0.0),
        "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "off": F.lit(1.0),
    })
    state = stage_table(state, "mix-tilts")
    key = by_size.select(F.col("source").alias("__source"), "size", F.col("docs").alias("rows"))
    for _ in range(MAX_STEPS):
        joined = key.join(state, key["__source"].eqNullSafe(state["source"]))
        rate = tilted(F.col("tilt"), F.col("size"), F.col("mean"))
        words = F.col("size") * F.col("rows")
        sums = joined.groupBy("__source").agg(
            F.sum(words * rate).alias("taken"), F.sum(words * rate * (1 - rate / MOST_COPIES) * F.col("size") / F.col("mean")).alias("slope")
        )
        now = state.join(sums, sums["__source"].eqNullSafe(state["source"])).drop("__source")
        gap = F.col("taken") - F.col("target")
        full = F.col("target") >= MOST_COPIES * F.col("source_size")
        off = F.when(full, 0.0).otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        bounded = F.greatest(F.least(newton, F.col("tilt") + 8), F.col("tilt") - 8)
        step = F.when(off < TOLERANCE, F.col("tilt")).when(inside, bounded).otherwise((low + high) / 2)
        state = stage_table(
            now.select("source", "source_size", "docs", "units", "target", "mean", F.round(step, 10).alias("tilt"), low.alias("low"), high.alias("high"), off.alias("off")),
            "mix-tilts",
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    return state.drop("low", "high", "off")


def rounded(units: DataFrame, balanced: DataFrame) -> DataFrame:
    """``(doc_id, source, size, n, source_size, target, rate, copies)``: whole copies of all of a unit's rows together.

    The units of a source are hashed into blocks of about ``BLOCK_ROWS``. In a block they are gone through by falling
    size; each takes the whole number of copies next to its rate that best makes up for the words owed so far, so a
    block ends within about its smallest documents of its share. Equal rows were counted before, so no hash is hot.
    """
    key = units.withColumnRenamed("source", "__source")
    joined = key.join(balanced, key["__source"].eqNullSafe(balanced["source"])).drop("__source")
    rate = F.when(F.col("target") >= MOST_COPIES * F.col("source_size"), float(MOST_COPIES)).otherwise(
        tilted(F.col("tilt"), F.col("size"), F.col("mean"))
    )
    mark = F.xxhash64("doc_id", "size")
    blocks = F.ceil(F.col("units") / BLOCK_ROWS)
    dealt = joined.select(
        "source", "source_size", "target", F.pmod(mark, blocks).alias("block"),
        F.struct((-F.col("size")).alias("down"), mark.alias("mark"), "doc_id", "size", "n", rate.alias("rate")).alias("unit"),
    )
    grouped = dealt.groupBy("source", "source_size", "target", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))

    def step(state: Column, unit: Column) -> Column:
        size, n, r = unit["size"], unit["n"], unit["rate"]
        owed = state["owed"] + n * r * size
        best = F.when(size == 0, n).otherwise(F.round(owed / size).cast("long"))
        copies = F.least(F.greatest(best, n * F.floor(r)), n * F.ceil(r))
        return F.struct((owed - copies * size).alias("owed"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("copies"))
    copies = F.aggregate("units", start, step, lambda s: s["copies"])
    flat = grouped.select("source", "source_size", "target", F.explode(F.arrays_zip("units", copies.alias("copies"))).alias("u"))
    return flat.select("source", "source_size", "target", "u.units.doc_id", "u.units.size", "u.units.n", "u.units.rate", "u.copies")


def copies_of_row(row: Column) -> Column:
    """What the ``row``-th of a unit's ``n`` equal rows gets of its ``copies``; counted from 1."""
    return F.expr("copies div n") + (row <= F.col("copies") % F.col("n")).cast("long")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The staged result of ``rounded`` for ``docs``."""
    units = stage_table(unit_sizes(docs, id_col, text_col, source_col), "mix-units")
    by_size = stage_table(
        units.groupBy("source", "size").agg(F.sum("n").alias("docs"), F.count("*").alias("units")), "mix-sizes"
    )
    return rounded(units, balance(by_size, stage_table(source_targets(by_size), "mix-targets")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source, rate, copies`` of every row of ``docs``.

    The result depends on the rows alone, not on their order or partitions. A null source is a source, the last. A
    null or blank text has size 0 and gives nothing. Repeated rows share their copies as evenly as can be. A source
    without any word has target 0. An empty table gives none. Other columns are not looked at.
    """
    planned = plan_mix(docs, id_col, text_col, source_col)
    rows = planned.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("copies", copies_of_row(F.col("row")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with the columns of ``docs``, whatever their names.

    Only rows that share id, source and size are numbered, by a hash of the text.
    """
    return on_plain_names(docs, _mixed, id_col, text_col, source_col)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    planned = plan_mix(docs, id_col, text_col, source_col).where("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__from"), F.col("size").alias("__words"), "n", "copies"
    )
    planned = stage_table(planned.withColumnsRenamed({"n": "__n", "copies": "__copies"}), "mix-copies")
    sized = docs.withColumn("__size", word_count(F.col(text_col)))
    at = sized[id_col].eqNullSafe(planned["__id"]) & sized[source_col].eqNullSafe(planned["__from"]) & (sized["__size"] == planned["__words"])
    # the plan has a row per document, so it is never broadcast, at any size
    joined = sized.join(planned.hint("merge"), at).drop("__id", "__from", "__words")
    rows = joined.where("__n = 1").withColumn("__times", F.col("__copies"))
    if not planned.where("__n > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy(id_col, source_col, "__size").orderBy(F.xxhash64(text_col)))
        several = joined.where("__n > 1").withColumn("__row", number)
        times = F.expr("__copies div __n") + (F.col("__row") <= F.col("__copies") % F.col("__n")).cast("long")
        rows = rows.unionByName(several.withColumn("__times", times).drop("__row"))
    rows = rows.where("__times > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)
