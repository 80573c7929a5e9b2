"""Sums and least values over all pairs of aircraft of a tick, without a row for any pair.

The aircraft of a tick are dealt into blocks of bounded size, and every two blocks meet in one task, which goes through them in
strips of arrays. Rows of aircraft are all that is shuffled, each as often as its tick has blocks, and rows of results are all
that leaves a task. The number of pairs still grows with the square of a tick's traffic, so that time does, but neither
memory, nor disk, nor the rows of any step.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.plans.components import LOCAL_LINKS, local_stars

c = F.col
#: Aircraft in a block, on average, and pairs in a strip, so that its arrays stay in a core's cache.
BLOCK_ROWS, STRIP_PAIRS = 4096, 1 << 15
#: Edges that a task keeps before they leave it.
HELD_EDGES = 1 << 19
FT_M = 0.3048
COS_CENTRE = math.cos(math.radians(geo.CENTRE_LAT))
Side = dict[str, np.ndarray]


def meet_blocks(states: DataFrame, columns: dict[str, Column], run: Callable, schema: str, block_rows: int | None = None, keys: tuple[str, ...] = ("tick",)) -> DataFrame:
    """``run`` over every two blocks of each tick, and over each block with itself; it gets ``tick, id, own, low, high`` and ``columns``.

    Every pair of rows of a tick with different ids is in exactly one of the tables that ``run`` gets. ``keys`` may name a
    smaller unit than a tick.
    """
    block_rows = block_rows or BLOCK_ROWS
    known = " and ".join(f"{k} is not null" for k in (*keys, "trajectory_id"))
    rows = states.where(known).select(*keys, c("trajectory_id").alias("id"), *[v.alias(k) for k, v in columns.items()])
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(sizes, [*keys]).withColumn("own", F.pmod(F.xxhash64("id"), c("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", *columns)
    # a number of partitions that is asked for stays: by their bytes alone these would be joined to too few
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *keys, "low", "high").groupBy(*keys, "low", "high").applyInArrow(run, schema)


def meet_rows(states: DataFrame, columns: dict[str, Column], rows: Callable[[pa.Table], Iterator[dict[str, np.ndarray]]], schema: pa.Schema) -> DataFrame:
    """Rows that ``rows`` makes of every two blocks, strip by strip: results that are pairs themselves leave a task as they are made, so that
    neither a block's pairs nor a tick's are ever held together. What is not a number becomes null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        tick = table.column("tick")[0].as_py()
        for part in rows(table):
            part["tick"] = np.full(len(part["id1"]), tick)
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type, from_pandas=True) for f in schema], schema=schema)

    sql = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    return meet_blocks(states, columns, run, ", ".join(f"{f.name} {sql[f.type]}" for f in schema))


def pair_schema(**more: pa.DataType) -> pa.Schema:
    return pa.schema([("tick", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), *more.items()])


def motion_columns() -> dict[str, Column]:
    """Places, heights and speeds on the sector's plane, by the formulas of ``pairs.with_relative``."""
    east, north = geo.velocity_nm_s(c("trk_deg"), c("gs_mps"))
    return {"lat": c("lat"), "lon": c("lon"), "alt": c("alt_m"), "trk": c("trk_deg"), "ve": east, "vn": north}


def sides(table: pa.Table, by: str | None = None) -> tuple[Side, Side, bool]:
    """Both blocks as arrays, in order of ``by``, and whether they are one and the same."""
    cols = {n: table.column(n).to_numpy() for n in table.column_names if n not in ("low", "high", "tick")}
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()

    def block(k: int) -> Side:
        side = {n: v[cols["own"] == k] for n, v in cols.items() if n != "own"}
        order = np.argsort(side[by], kind="stable") if by else slice(None)
        return {n: v[order] for n, v in side.items()}

    a = block(low)
    return (a, a, True) if low == high else (a, block(high), False)


def strips(a: Side, b: Side, same: bool, reach: float | None = None, by: str = "alt") -> Iterator[tuple[slice, slice]]:
    """Slices of both sides that hold every pair once or more; with ``reach``, those whose ``by``, by default their height in metres, differs by
    less, in sides in its order."""
    rows, n, m = max(1, STRIP_PAIRS // max(1, len(b["id"]))), len(a["id"]), len(b["id"])
    k = 0
    while k < n:
        first, last = k if same else 0, m
        if reach is not None:
            low, high = a[by][k] - reach, a[by][min(k + rows, n) - 1] + reach
            first, last = max(first, int(np.searchsorted(b[by], low, "left"))), int(np.searchsorted(b[by], high, "right"))
        stop = min(n, k + rows)
        if last > first:
            yield slice(k, stop), slice(first, last)
        k = stop


def together(a: Side, b: Side, same: bool, k: slice, span: slice) -> np.ndarray | None:
    """Which places of a strip are pairs; none is left out if they are of different blocks."""
    if not same:
        return None
    return (np.arange(k.start, k.stop)[:, None] < np.arange(span.start, span.stop)) & (a["id"][k, None] != b["id"][None, span])


def approach(a: Side, b: Side, k: slice, span: slice, horizon_s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance now, time and distance of the closest approach, as in ``pairs.with_cpa``; what is not known is not a number."""
    east = b["lon"][None, span] - a["lon"][k, None]
    over = np.abs(east) >= 180.0
    if over.any():
        east = east - 360.0 * np.rint(east / 360.0)
    rx, ry = east * 60.0 * COS_CENTRE, (b["lat"][None, span] - a["lat"][k, None]) * 60.0
    vx, vy = b["ve"][None, span] - a["ve"][k, None], b["vn"][None, span] - a["vn"][k, None]
    vv = vx * vx + vy * vy
    with np.errstate(divide="ignore", invalid="ignore"):
        tcpa = np.fmax(0.0, np.fmin(horizon_s, -(rx * vx + ry * vy) / vv))
    tcpa[vv <= 1e-12] = 0.0
    now = np.sqrt(rx * rx + ry * ry)
    vx *= tcpa
    vy *= tcpa
    rx += vx
    ry += vy
    return now, tcpa, np.sqrt(rx * rx + ry * ry)


def near_approaches(table: pa.Table, gate_nm: float, vertical_ft: float, horizon_s: float) -> Iterator[tuple[Side, Side, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, i, j, now, tcpa, cpa`` of pairs whose closest approach is under the gate and whose heights differ by less."""
    a, b, same = sides(table, "alt")
    for k, span in strips(a, b, same, vertical_ft * FT_M * 1.001):
        now, tcpa, cpa = approach(a, b, k, span, horizon_s)
        kept = (cpa < gate_nm) & (np.abs(a["alt"][k, None] - b["alt"][None, span]) / FT_M < vertical_ft)
        pairs = together(a, b, same, k, span)
        i, j = np.nonzero(kept if pairs is None else kept & pairs)
        if len(i):
            yield a, b, i + k.start, j + span.start, now[i, j], tcpa[i, j], cpa[i, j]


def turn(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The difference of courses in [0, 180], of the smaller id's less the other's."""
    d = np.where(a["id"][i] < b["id"][j], a["trk"][i] - b["trk"][j], b["trk"][j] - a["trk"][i])
    return np.abs(np.mod(d + 180.0, 360.0) - 180.0)


def result(table: pa.Table, schema: pa.Schema, **columns) -> pa.Table:
    """Rows of a block's tick."""
    n = len(next(iter(columns.values())))
    columns["tick"] = np.full(n, table.column("tick")[0].as_py() if table.num_rows else 0)
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def edge_kinds(states: DataFrame, gate_nm: float, vertical_ft: float = 1000.0, horizon_s: float = 300.0, widths: tuple[float, float, float] = (15.0, 500.0, 30.0)) -> DataFrame:
    """``tick, turn, height, time, n, min_tcpa``: how many close approaches of a tick have a difference of courses, of heights in feet and a
    time that round to so many of ``widths``. The kinds are bounded by their ranges, whatever the traffic is."""
    schema = pa.schema([("tick", pa.int64()), ("turn", pa.int64()), ("height", pa.int64()), ("time", pa.int64()), ("n", pa.int64()), ("min_tcpa", pa.float64())])
    most = [int(round(top / w)) + 1 for top, w in zip((180.0, vertical_ft, horizon_s), widths)]

    def run(table: pa.Table) -> pa.Table:
        n, least = np.zeros(math.prod(most), np.int64), np.full(math.prod(most), np.inf)
        for a, b, i, j, _, tcpa, _ in near_approaches(table, gate_nm, vertical_ft, horizon_s):
            height = np.abs(a["alt"][i] - b["alt"][j]) / FT_M
            parts = [np.rint(x / w).astype(np.int64) for x, w in zip((turn(a, b, i, j), height, tcpa), widths)]
            kind = np.ravel_multi_index(parts, most)
            n += np.bincount(kind, minlength=len(n))
            np.minimum.at(least, kind, tcpa)
        kinds = np.flatnonzero(n)
        at = np.unravel_index(kinds, most)
        return result(table, schema, turn=at[0], height=at[1], time=at[2], n=n[kinds], min_tcpa=least[kinds])

    found = meet_blocks(states, motion_columns(), run, "tick long, turn long, height long, time long, n long, min_tcpa double")
    return found.groupBy("tick", "turn", "height", "time").agg(F.sum("n").alias("n"), F.min("min_tcpa").alias("min_tcpa"))


def ranked_edges(ranked: DataFrame, gate_nm: float, width_s: float, vertical_ft: float = 1000.0, horizon_s: float = 300.0) -> DataFrame:
    """``tick, low, edges``: the close approaches of a tick between the ranks ``role`` of its aircraft, under the lower rank of each; ``edges`` packs
    the other rank and the time in ``width_s`` into four bytes. A rank may have several rows, and a task holds ``HELD_EDGES`` or a strip at most."""
    schema = pa.schema([("tick", pa.int64()), ("low", pa.int64()), ("edges", pa.binary())])
    times = int(round(horizon_s / width_s)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        tick = table.column("tick")[0].as_py()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            low, other = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(low, kind="stable")
            low, starts = np.unique(low[order], return_index=True)
            parts = [x.astype("<u4").tobytes() for x in np.split(other[order], starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(low), tick)), pa.array(low), pa.array(parts, pa.binary())], schema=schema)

        for a, b, i, j, _, tcpa, _ in near_approaches(table, gate_nm, vertical_ft, horizon_s):
            one, two = a["role"][i], b["role"][j]
            held.append((np.minimum(one, two), np.maximum(one, two) * times + np.rint(tcpa / width_s).astype(np.int64)))
            if sum(len(x) for x, _ in held) >= HELD_EDGES:
                yield packed()
        if held:
            yield packed()

    return meet_blocks(ranked, {**motion_columns(), "role": c("role")}, run, "tick long, low long, edges binary")


def text_order(n: np.ndarray) -> np.ndarray:
    """Whole numbers under 10 ** 10 that order ``n`` as their decimal texts are ordered, before a comma or an end."""
    digits = np.searchsorted(10 ** np.arange(1, 11), n, "right") + 1
    return n * 10 ** (10 - digits) * 16 + digits


def edges_hashed(edges: DataFrame, width_s: float, horizon_s: float = 300.0, digits: int = 24) -> DataFrame:
    """``tick, fingerprint``: the start of the hash of a tick's edges of ``ranked_edges`` as texts ``low,high,time`` in order, joined by semicolons.

    Ranks are sorted by Spark in the order of their texts, and the text is hashed some whole ranks at a time, so that no row and no task holds a
    tick's edges.
    """
    times, schema = int(round(horizon_s / width_s)) + 1, pa.schema([("tick", pa.int64()), ("fingerprint", pa.string())])

    def text_of(rows: list[tuple[int, bytes]]) -> bytes:
        lows = list(dict.fromkeys(low for low, _ in rows))
        places = {low: k for k, low in enumerate(lows)}
        place = np.repeat([places[low] for low, _ in rows], [len(e) // 4 for _, e in rows])
        high, time = np.divmod(np.frombuffer(b"".join(e for _, e in rows), "<u4").astype(np.int64), times)
        order = np.lexsort((text_order(time), text_order(high), place))
        texts = [pa.array(x[order]).cast(pa.string()) for x in (np.array(lows)[place], high, time)]
        texts = pc.binary_join_element_wise(*texts, ",")
        return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), ";")[0].as_py().encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, many, before, h = None, [], 0, b"", hashlib.sha256()
        done: list[tuple[int, str]] = []
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("tick", "low", "edges"))))
        for tick, low, some in itertools.chain(rows, [(None, None, b"")]):
            if held and (tick != at or many >= HELD_EDGES and low != held[-1][0]):
                h.update(before + text_of(held))
                held, many, before = [], 0, b";"
            if tick != at:
                if at is not None:
                    done.append((at, h.hexdigest()[:digits]))
                at, before, h = tick, b"", hashlib.sha256()
            held.append((low, some))
            many += len(some) // 4
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(schema)], schema=schema)

    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = edges.withColumn("text", c("low").cast("string")).repartition(tasks, "tick").sortWithinPartitions("tick", "text").drop("text")
    return lined.mapInArrow(run, "tick long, fingerprint string")


def approach_degrees(states: DataFrame, gate_nm: float, vertical_ft: float = 1000.0, horizon_s: float = 300.0) -> DataFrame:
    """``tick, id, degree, min_tcpa``: how many close approaches each aircraft has, and the earliest; those without any have no row."""
    schema = pa.schema([("tick", pa.int64()), ("id", pa.int64()), ("degree", pa.int64()), ("min_tcpa", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        found: dict[int, tuple[Side, np.ndarray, np.ndarray]] = {}
        for a, b, i, j, _, tcpa, _ in near_approaches(table, gate_nm, vertical_ft, horizon_s):
            for side, at in ((a, i), (b, j)):
                _, degree, least = found.setdefault(id(side), (side, np.zeros(len(side["id"]), np.int64), np.full(len(side["id"]), np.inf)))
                degree += np.bincount(at, minlength=len(degree))
                np.minimum.at(least, at, tcpa)
        parts = [(side["id"][degree > 0], degree[degree > 0], least[degree > 0]) for side, degree, least in found.values()]
        ids, degree, least = map(np.concatenate, zip(*parts)) if parts else ([], [], [])
        return result(table, schema, id=ids, degree=degree, min_tcpa=least)

    found = meet_blocks(states, motion_columns(), run, "tick long, id long, degree long, min_tcpa double")
    return found.groupBy("tick", "id").agg(F.sum("degree").alias("degree"), F.min("min_tcpa").alias("min_tcpa"))


def closest_of_all(states: DataFrame, horizon_s: float = 300.0) -> DataFrame:
    """``tick, trajectory_id, near_nm, cpa``: each aircraft's least distance to another of its tick, and its least closest approach
    as ``cpa_nm, tcpa``; null where none is known."""
    schema = pa.schema([("tick", pa.int64()), ("trajectory_id", pa.int64()), ("near_nm", pa.float64()), ("cpa_nm", pa.float64()), ("tcpa", pa.float64())])

    def least(kept: Side, at: slice, now: np.ndarray, tcpa: np.ndarray, cpa: np.ndarray, axis: int) -> None:
        near, best = now.min(axis), cpa.min(axis)
        time = np.where(cpa == (best[:, None] if axis else best), tcpa, np.inf).min(axis)
        np.minimum(kept["near"][at], near, out=kept["near"][at])
        before, was = kept["cpa"][at], kept["tcpa"][at]
        kept["tcpa"][at] = np.where(best < before, time, np.where(best == before, np.minimum(time, was), was))
        kept["cpa"][at] = np.minimum(before, best)

    def run(table: pa.Table) -> pa.Table:
        a, b, same = sides(table)
        kept = lambda side: {n: np.full(len(side["id"]), np.inf) for n in ("near", "cpa", "tcpa")}
        of_a = kept(a)
        of_b = of_a if same else kept(b)
        for k, span in strips(a, b, same):
            now, tcpa, cpa = approach(a, b, k, span, horizon_s)
            pairs = together(a, b, same, k, span)
            for x in (now, cpa):
                x[np.isnan(x) if pairs is None else np.isnan(x) | ~pairs] = np.inf
            least(of_a, k, now, tcpa, cpa, 1)
            least(of_b, span, now, tcpa, cpa, 0)
        both = [(a, of_a)] if same else [(a, of_a), (b, of_b)]
        joined = lambda n: np.concatenate([kept[n] for _, kept in both])
        return result(table, schema, trajectory_id=np.concatenate([side["id"] for side, _ in both]), near_nm=joined("near"), cpa_nm=joined("cpa"), tcpa=joined("tcpa"))

    found = meet_blocks(states, motion_columns(), run, "tick long, trajectory_id long, near_nm double, cpa_nm double, tcpa double")
    known = lambda x: F.when(c(x) < math.inf, c(x))
    found = found.groupBy("tick", "trajectory_id").agg(F.min(known("near_nm")).alias("near_nm"), F.min(F.when(c("cpa_nm") < math.inf, F.struct("cpa_nm", "tcpa"))).alias("cpa"))
    return found


GEOMETRIES = ("head_on", "overtaking", "parallel", "crossing", "converging")
RISKS = ("critical", "high", "medium", "low")


def geometry_of(turned: np.ndarray, now: np.ndarray, gate_nm: float) -> np.ndarray:
    """Numbers of ``GEOMETRIES``, by the rules of ``pairs.geometry``."""
    d = np.rint(turned)
    return np.select([d >= 150, (d <= 20) & (now < gate_nm), d <= 20, (d >= 55) & (d <= 125)], [0, 1, 2, 3], 4)


def risk_of(now: np.ndarray, tcpa: np.ndarray, cpa: np.ndarray, loss_nm: float) -> np.ndarray:
    """Numbers of ``RISKS``, by the rules of ``pairs.risk``."""
    minutes = tcpa / 60
    return np.select([(now < loss_nm) | (cpa < 1.0) | (minutes <= 2.0), (cpa < 3.0) | (minutes <= 5.0), (cpa < loss_nm) | (minutes <= 8.0)], [0, 1, 2], 3)


def named(names: tuple[str, ...], number: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), c(number).cast("int"))


def approach_kinds(states: DataFrame, gate_nm: float, loss_nm: float, vertical_ft: float = 1000.0, horizon_s: float = 300.0) -> DataFrame:
    """``geometry, risk, n, min_cpa, min_tcpa`` of close approaches."""
    schema = pa.schema([("tick", pa.int64()), ("kind", pa.int64()), ("n", pa.int64()), ("min_cpa", pa.float64()), ("min_tcpa", pa.float64())])
    many = len(GEOMETRIES) * len(RISKS)

    def run(table: pa.Table) -> pa.Table:
        n, nearest, first = np.zeros(many, np.int64), np.full(many, np.inf), np.full(many, np.inf)
        for a, b, i, j, now, tcpa, cpa in near_approaches(table, gate_nm, vertical_ft, horizon_s):
            kind = geometry_of(turn(a, b, i, j), now, gate_nm) * len(RISKS) + risk_of(now, tcpa, cpa, loss_nm)
            n += np.bincount(kind, minlength=many)
            np.minimum.at(nearest, kind, cpa)
            np.minimum.at(first, kind, tcpa)
        kinds = np.flatnonzero(n)
        return result(table, schema, kind=kinds, n=n[kinds], min_cpa=nearest[kinds], min_tcpa=first[kinds])

    found = meet_blocks(states, motion_columns(), run, "tick long, kind long, n long, min_cpa double, min_tcpa double")
    found = found.groupBy("kind").agg(F.sum("n").alias("n"), F.min("min_cpa").alias("min_cpa"), F.min("min_tcpa").alias("min_tcpa"))
    return found.withColumns({"g": F.floor(c("kind") / len(RISKS)), "r": c("kind") % len(RISKS)}).select(named(GEOMETRIES, "g").alias("geometry"), named(RISKS, "r").alias("risk"), "n", "min_cpa", "min_tcpa")


def approach_context(states: DataFrame, gate_nm: float, vertical_ft: float = 1000.0, horizon_s: float = 300.0, pressing_min: float = 3.0, pressing_nm: float = 3.0) -> DataFrame:
    """``tick, id, of_<geometry>..., urgent``: how many close approaches of each geometry an aircraft has, and how many other than
    head-on ones are soon or very near; those without any have no row."""
    names = [f"of_{g}" for g in GEOMETRIES] + ["urgent"]
    schema = pa.schema([("tick", pa.int64()), ("id", pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        found: dict[int, tuple[Side, np.ndarray]] = {}
        for a, b, i, j, now, tcpa, cpa in near_approaches(table, gate_nm, vertical_ft, horizon_s):
            kind = geometry_of(turn(a, b, i, j), now, gate_nm)
            urgent = (kind != 0) & ((tcpa / 60 <= pressing_min) | (cpa < pressing_nm))
            for side, at in ((a, i), (b, j)):
                many = len(side["id"])
                _, counts = found.setdefault(id(side), (side, np.zeros((len(names), many), np.int64)))
                counts[:-1] += np.bincount(kind * many + at, minlength=many * len(GEOMETRIES)).reshape(-1, many)
                counts[-1] += np.bincount(at[urgent], minlength=many)
        parts = [(side["id"][counts[:-1].any(0)], counts[:, counts[:-1].any(0)]) for side, counts in found.values()]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        counts = np.concatenate([p[1] for p in parts], 1) if parts else np.zeros((len(names), 0), np.int64)
        return result(table, schema, id=ids, **dict(zip(names, counts)))

    found = meet_blocks(states, motion_columns(), run, "tick long, id long, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("tick", "id").agg(*[F.sum(n).alias(n) for n in names])


def pair_risks(states: DataFrame, loss_nm: float, horizon_s: float = 300.0) -> DataFrame:
    """``tick, risk, n`` of all pairs of a tick."""
    schema = pa.schema([("tick", pa.int64()), ("kind", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = sides(table)
        n = np.zeros(len(RISKS), np.int64)
        for k, span in strips(a, b, same):
            pairs = together(a, b, same, k, span)
            kind = risk_of(*approach(a, b, k, span, horizon_s), loss_nm)
            n += np.bincount(kind.ravel() if pairs is None else kind[pairs], minlength=len(RISKS))
        kinds = np.flatnonzero(n)
        return result(table, schema, kind=kinds, n=n[kinds])

    found = meet_blocks(states, motion_columns(), run, "tick long, kind long, n long")
    return found.groupBy("tick", named(RISKS, "kind").alias("risk")).agg(F.sum("n").alias("n"))


def pair_geometries(states: DataFrame, gate_nm: float) -> DataFrame:
    """``geometry, n`` of all pairs of a tick."""
    schema = pa.schema([("tick", pa.int64()), ("kind", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = sides(table)
        n = np.zeros(len(GEOMETRIES), np.int64)
        for k, span in strips(a, b, same):
            pairs = together(a, b, same, k, span)
            i, j = np.nonzero(np.ones((k.stop - k.start, span.stop - span.start), bool) if pairs is None else pairs)
            now = distance_now(a, b, k, span)[i, j]
            n += np.bincount(geometry_of(turn(a, b, i + k.start, j + span.start), now, gate_nm), minlength=len(GEOMETRIES))
        kinds = np.flatnonzero(n)
        return result(table, schema, kind=kinds, n=n[kinds])

    found = meet_blocks(states, motion_columns(), run, "tick long, kind long, n long")
    return found.groupBy(named(GEOMETRIES, "kind").alias("geometry")).agg(F.sum("n").alias("n"))


def close_approaches(states: DataFrame, gate_nm: float, vertical_ft: float, horizon_s: float = 300.0) -> DataFrame:
    """``tick, id1, id2, tcpa, cpa_nm, vsep_ft`` of pairs whose closest approach is under the gate and whose heights differ by less."""

    def rows(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        for a, b, i, j, _, tcpa, cpa in near_approaches(table, gate_nm, vertical_ft, horizon_s):
            one, two = a["id"][i], b["id"][j]
            yield {"id1": np.minimum(one, two), "id2": np.maximum(one, two), "tcpa": tcpa, "cpa_nm": cpa, "vsep_ft": np.abs(a["alt"][i] - b["alt"][j]) / FT_M}

    return meet_rows(states, motion_columns(), rows, pair_schema(tcpa=pa.float64(), cpa_nm=pa.float64(), vsep_ft=pa.float64()))


def all_approaches(states: DataFrame, horizon_s: float = 300.0) -> DataFrame:
    """``tick, id1, id2, tcpa, cpa_nm, now_nm`` of all pairs of a tick, each once."""

    def rows(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        a, b, same = sides(table)
        for k, span in strips(a, b, same):
            pairs = together(a, b, same, k, span)
            kept = slice(None) if pairs is None else pairs.ravel()
            one, two = (x.ravel()[kept] for x in np.broadcast_arrays(a["id"][k, None], b["id"][None, span]))
            now, tcpa, cpa = (x.ravel()[kept] for x in approach(a, b, k, span, horizon_s))
            yield {"id1": np.minimum(one, two), "id2": np.maximum(one, two), "tcpa": tcpa, "cpa_nm": cpa, "now_nm": now}

    return meet_rows(states, motion_columns(), rows, pair_schema(tcpa=pa.float64(), cpa_nm=pa.float64(), now_nm=pa.float64()))


def distance_now(a: Side, b: Side, k: slice, span: slice) -> np.ndarray:
    east = b["lon"][None, span] - a["lon"][k, None]
    if (np.abs(east) >= 180.0).any():
        east = east - 360.0 * np.rint(east / 360.0)
    east, north = east * 60.0 * COS_CENTRE, (b["lat"][None, span] - a["lat"][k, None]) * 60.0
    return np.sqrt(east * east + north * north)


def near_now(table: pa.Table, gate_nm: float, vertical_ft: float) -> Iterator[tuple[Side, Side, np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, i, j, now`` of pairs whose distance now is under the gate and whose heights differ by less."""
    a, b, same = sides(table, "alt")
    for k, span in strips(a, b, same, vertical_ft * FT_M * 1.001):
        now = distance_now(a, b, k, span)
        kept = (now < gate_nm) & (np.abs(a["alt"][k, None] - b["alt"][None, span]) / FT_M < vertical_ft)
        pairs = together(a, b, same, k, span)
        i, j = np.nonzero(kept if pairs is None else kept & pairs)
        if len(i):
            yield a, b, i + k.start, j + span.start, now[i, j]


def place_columns() -> dict[str, Column]:
    return {"lat": c("lat"), "lon": c("lon"), "alt": c("alt_m")}


def losses(states: DataFrame, gate_nm: float, vertical_ft: float) -> DataFrame:
    """``tick, n, min_nm, min_ft`` of the pairs of each tick that are nearer than both; ticks without any have no row."""
    schema = pa.schema([("tick", pa.int64()), ("n", pa.int64()), ("min_nm", pa.float64()), ("min_ft", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        n, nm, ft = 0, math.inf, math.inf
        for a, b, i, j, now in near_now(table, gate_nm, vertical_ft):
            n, nm, ft = n + len(i), min(nm, now.min()), min(ft, (np.abs(a["alt"][i] - b["alt"][j]) / FT_M).min())
        return result(table, schema, **({"n": [n], "min_nm": [nm], "min_ft": [ft]} if n else {"n": [], "min_nm": [], "min_ft": []}))

    found = meet_blocks(states, place_columns(), run, "tick long, n long, min_nm double, min_ft double")
    return found.groupBy("tick").agg(F.sum("n").alias("n"), F.min("min_nm").alias("min_nm"), F.min("min_ft").alias("min_ft"))


def loss_links(states: DataFrame, gate_nm: float, vertical_ft: float) -> DataFrame:
    """``tick, id1, id2``: links with the components of all pairs that are nearer than both, of which every two blocks leave fewer than they
    have aircraft."""
    schema = pa.schema([("tick", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b, i, j, _ in near_now(table, gate_nm, vertical_ft):
            kept.append((a["id"][i], b["id"][j]))
            if sum(len(x) for x, _ in kept) > LOCAL_LINKS:
                kept = [local_stars(*map(np.concatenate, zip(*kept)))]
        u, v = local_stars(*map(np.concatenate, zip(*kept)))
        return result(table, schema, id1=v, id2=u)

    return meet_blocks(states, place_columns(), run, "tick long, id1 long, id2 long")


def neighbourhoods(states: DataFrame, radius_nm: float, turned_deg: float) -> DataFrame:
    """``tick, trajectory_id, n_near, mean_gs, mean_vs, mean_lat, mean_lon`` over the aircraft of a tick, itself included, that are within the radius
    and whose courses differ by so much at most. Aircraft of equal place and course are one point with their sums, so that copies make no pairs."""
    at, values = ["lat", "lon", "trk_deg"], ["gs_mps", "vs_mps"]
    known = states.where("tick is not null and trajectory_id is not null and lat is not null and lon is not null and trk_deg is not null")
    sums = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("sum", F.sum), ("n", F.count))]
    points = known.groupBy("tick", *at).agg(F.min("trajectory_id").alias("trajectory_id"), F.count("*").alias("n"), *sums)
    made = {"n": c("n"), **{f"{n}_{v}": F.coalesce(c(f"{n}_{v}"), F.lit(0)) for v in values for n in ("sum", "n")}, "sum_lat": c("n") * c("lat"), "sum_lon": c("n") * c("lon")}
    columns = {"lat": c("lat"), "lon": c("lon"), "trk": F.pmod(c("trk_deg"), F.lit(360.0)), **{k: v.cast("double") for k, v in made.items()}}
    names = list(made)
    schema = pa.schema([("tick", pa.int64()), ("id", pa.int64()), *[(n, pa.float64()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = sides(table)
        table_of = lambda side: np.stack([side[n] for n in names], 1)
        of_a, of_b = table_of(a), table_of(b)
        got_a, got_b = (of_a.copy() if same else np.zeros_like(of_a)), np.zeros_like(of_b)
        for k, span in strips(a, b, same):
            turned = np.abs(b["trk"][None, span] - a["trk"][k, None])
            kept = (distance_now(a, b, k, span) <= radius_nm) & ((turned <= turned_deg) | (turned >= 360.0 - turned_deg))
            pairs = together(a, b, same, k, span)
            kept = (kept if pairs is None else kept & pairs).astype(np.float64)
            got_a[k] += kept @ of_b[span]
            got_b[span] += kept.T @ of_a[k]
        ids, got = (a["id"], got_a + got_b) if same else (np.concatenate([a["id"], b["id"]]), np.concatenate([got_a, got_b]))
        return result(table, schema, id=ids, **dict(zip(names, got.T)))

    found = meet_blocks(points, columns, run, "tick long, id long, " + ", ".join(f"{n} double" for n in names))
    found = found.groupBy("tick", "id").agg(*[F.sum(n).alias(n) for n in names])
    mean = lambda total, n, name: F.when(c(n) > 0, c(total) / c(n)).alias(name)
    found = found.select(
        "tick", "id", c("n").cast("long").alias("n_near"), mean("sum_gs_mps", "n_gs_mps", "mean_gs"), mean("sum_vs_mps", "n_vs_mps", "mean_vs"),
        mean("sum_lat", "n", "mean_lat"), mean("sum_lon", "n", "mean_lon"),
    )
    own = known.select("tick", "trajectory_id", *at).join(points.select("tick", *at, c("trajectory_id").alias("id")), ["tick", *at])
    return own.join(found, ["tick", "id"]).select("tick", "trajectory_id", "n_near", "mean_gs", "mean_vs", "mean_lat", "mean_lon")


def squared(limit: float) -> float:
    """The least square whose root reaches the limit, so that squares can be compared in place of roots."""
    x = limit * limit
    while math.sqrt(math.nextafter(x, 0.0)) >= limit:
        x = math.nextafter(x, 0.0)
    while math.sqrt(x) < limit:
        x = math.nextafter(x, math.inf)
    return x


Motion = Callable[[Side, float], tuple[np.ndarray, np.ndarray, np.ndarray]]


def grid_least(a: Side, b: Side, k: slice, span: slice, moved_a: list, moved_b: list, limit_nm: float) -> tuple[np.ndarray, np.ndarray]:
    """The least distance of every pair of a strip over a time grid, and the least difference of heights while nearer than the limit, which is
    infinite if they never are. ``moved_a`` and ``moved_b`` are east, north and height of either side at each time."""
    within, least, gap = squared(limit_nm), None, None
    for (x1, y1, z1), (x2, y2, z2) in zip(moved_a, moved_b):
        dx, dy = x2[None, span] - x1[k, None], y2[None, span] - y1[k, None]
        dx *= dx
        dy *= dy
        dx += dy
        dz = np.abs(z2[None, span] - z1[k, None])
        dz[~(dx < within)] = np.inf
        least = dx if least is None else np.fmin(least, dx, out=least)
        gap = dz if gap is None else np.fmin(gap, dz, out=gap)
    return np.sqrt(least), gap


def rolled_out(states: DataFrame, columns: dict[str, Column], acting: Motion, other: Motion, times: list[float], limit_nm: float, limit_m: float) -> DataFrame:
    """``tick, id1, id2, min_nm, min_m, unsafe`` of all ordered pairs of a tick, the first side moving by ``acting``, the second by ``other``.

    Either motion is worked out once for an aircraft of a block, and the grid is gone through for strips of pairs.
    """

    def rows(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        a, b, same = sides(table)
        moved = lambda side, by: [by(side, t) for t in times]
        for one, two in [(a, a)] if same else [(a, b), (b, a)]:
            moved_one, moved_two = moved(one, acting), moved(two, other)
            for k, span in strips(one, two, False):
                nm, m = grid_least(one, two, k, span, moved_one, moved_two, limit_nm)
                id1, id2 = (x.ravel() for x in np.broadcast_arrays(one["id"][k, None], two["id"][None, span]))
                kept = id1 != id2 if same else slice(None)
                nm, m = nm.ravel()[kept], m.ravel()[kept]
                yield {"id1": id1[kept], "id2": id2[kept], "min_nm": nm, "min_m": np.where(np.isinf(m), np.nan, m), "unsafe": m < limit_m}

    found = meet_rows(states, columns, rows, pair_schema(min_nm=pa.float64(), min_m=pa.float64(), unsafe=pa.bool_()))
    return found


def plans_checked(states: DataFrame, columns: dict[str, Column], planned: Motion, times: list[float], limit_nm: float, limit_m: float) -> DataFrame:
    """``tick, checked, unsafe, min_nm`` over all pairs of a tick, both sides moving by ``planned``."""
    schema = pa.schema([("tick", pa.int64()), ("checked", pa.int64()), ("unsafe", pa.int64()), ("min_nm", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = sides(table)
        moved_a = [planned(a, t) for t in times]
        moved_b = moved_a if same else [planned(b, t) for t in times]
        checked, unsafe, least = 0, 0, math.inf
        for k, span in strips(a, b, same):
            nm, m = grid_least(a, b, k, span, moved_a, moved_b, limit_nm)
            pairs = together(a, b, same, k, span)
            if pairs is not None:
                nm, m = nm[pairs], m[pairs]
            checked, unsafe = checked + nm.size, unsafe + int((m < limit_m).sum())
            least = min(least, float(np.fmin.reduce(nm, axis=None, initial=math.inf)))
        some = [checked] if checked else []
        return result(table, schema, checked=some, unsafe=[unsafe][: len(some)], min_nm=[least][: len(some)])

    found = meet_blocks(states, columns, run, "tick long, checked long, unsafe long, min_nm double")
    known = F.when(c("min_nm") < math.inf, c("min_nm"))
    return found.groupBy("tick").agg(F.sum("checked").alias("checked"), F.sum("unsafe").alias("unsafe"), F.min(known).alias("min_nm"))
