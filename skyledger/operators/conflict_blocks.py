"""Directed state-based conflicts over blocks of a tick's aircraft, by the formulas of ``pairs.directed_conflicts``.

A strip of pairs is first told apart on a plane at the middle latitude of each pair, with room for what it leaves out; only pairs that may be in
conflict are worked out on the sphere, in both orders. Without a place or a speed there is no conflict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import blocks as B
from skyledger.operators.blocks import Side

c = F.col
ZONE_M, HEIGHT_M, AHEAD_S = 9260.0, 304.8, 300.0
EQUATOR_M, POLE_M = 6378137.0, 6356752.314245
#: Metres in a degree, the least radius, and how far apart places may be on a plane.
DEGREE_M, LEAST_M, PLANE_M = 111_200.0, POLE_M, 700_000.0
Terms = dict[str, np.ndarray]


def conflict_columns() -> dict[str, Column]:
    track = F.radians("trk_deg")
    return {"lat": c("lat"), "lon": c("lon"), "alt": c("alt_m"), "vs": c("vs_mps"), "u": c("gs_mps") * F.sin(track), "v": c("gs_mps") * F.cos(track)}


def radius_m(lat: np.ndarray) -> np.ndarray:
    co, si = np.cos(np.radians(lat)), np.sin(np.radians(lat))
    a, b = EQUATOR_M, POLE_M
    return np.sqrt(((a * a * co) ** 2 + (b * b * si) ** 2) / ((a * co) ** 2 + (b * si) ** 2))


def terms(one: Terms, two: Terms) -> tuple[np.ndarray, Terms]:
    """Which directed pairs are conflicts, and the terms of all of them."""
    lat1, lat2 = one["lat"], two["lat"]
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(two["lon"] - one["lon"])
    qdr = np.degrees(np.arctan2(np.sin(dl) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(dl)))
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    radius, over = radius_m(0.5 * (lat1 + lat2)), lat1 * lat2 < 0
    if over.any():
        across = 0.5 * (np.abs(lat1) * (radius_m(lat1) + EQUATOR_M) + np.abs(lat2) * (radius_m(lat2) + EQUATOR_M)) / np.maximum(np.abs(lat1) + np.abs(lat2), 0.001)
        radius = np.where(over, across, radius)
    dist = radius * (2 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0.0)))) / geo.NM_M * geo.NM_M
    dx, dy = dist * np.sin(np.radians(qdr)), dist * np.cos(np.radians(qdr))
    du, dv = two["u"] - one["u"], two["v"] - one["v"]
    dv2 = np.maximum(du * du + dv * dv, 1e-6)
    tcpa = -(du * dx + dv * dy) / dv2
    dcpa2 = np.abs(dist * dist - tcpa * tcpa * dv2)
    half = np.sqrt(np.maximum(0.0, ZONE_M * ZONE_M - dcpa2)) / np.sqrt(dv2)
    dvs = two["vs"] - one["vs"]
    dvs = np.where(np.abs(dvs) < 1e-6, 1e-6, dvs)
    dalt = two["alt"] - one["alt"]
    high, low = (dalt + HEIGHT_M) / -dvs, (dalt - HEIGHT_M) / -dvs
    # as in SQL, where the least and the greatest of values are those that are known
    into, out = np.fmax(tcpa - half, np.fmin(high, low)), np.fmin(tcpa + half, np.fmax(high, low))
    kept = (dcpa2 < ZONE_M * ZONE_M) & (into <= out) & (out > 0) & (into < AHEAD_S)
    return kept, {"qdr": qdr, "dist_m": dist, "tcpa": tcpa, "tinconf": into, "dx": dx, "dy": dy, "du": du, "dv": dv}


def small(side: Side) -> None:
    """Short numbers for telling pairs apart; a metre or so is lost."""
    half = np.radians(side["lat"]) / 2
    more = {"cos": np.cos(half), "sin": np.sin(half), "cos_lon": np.cos(np.radians(side["lon"]) / 2), "sin_lon": np.sin(np.radians(side["lon"]) / 2)}
    side["small"] = {n: v.astype(np.float32) for n, v in ({n: side[n] for n in ("lat", "lon", "alt", "vs", "u", "v")} | more).items()}


def candidates(a: Side, b: Side, k: slice, span: slice) -> np.ndarray:
    """Which places of a strip may be conflicts in either order: all that are, and some others."""
    one, two = a["small"], b["small"]
    between = lambda n: two[n][None, span] - one[n][k, None]
    east, y, du, dv = between("lon"), between("lat"), between("u"), between("v")
    if (np.abs(east) >= 180.0).any():
        east = east - np.float32(360.0) * np.rint(east / np.float32(360.0))
    x = one["cos"][k, None] * two["cos"][None, span] - one["sin"][k, None] * two["sin"][None, span]
    x *= east
    x *= np.float32(DEGREE_M)
    y *= np.float32(DEGREE_M)
    far = np.abs(x) + np.abs(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        dv2 = np.maximum(du * du + dv * dv, np.float32(1e-6))
        t = np.clip(-(x * du + y * dv) / dv2, np.float32(0.0), np.float32(AHEAD_S))
    # courses turn against each other by the difference of longitudes times the sine of the latitude
    outer = max(float(np.fmax.reduce(np.abs(s["lat"][at]), initial=0.0)) for s, at in ((one, k), (two, span)))
    room = far * np.float32((math.tan(math.radians(min(outer, 85.0))) + 0.1) / LEAST_M) + np.float32(0.004)
    room *= far
    room += np.float32(ZONE_M + 20.0)
    du *= t
    dv *= t
    x += du
    y += dv
    x *= x
    y *= y
    x += y
    room *= room
    found = x <= room
    beyond = far > PLANE_M
    if outer > 80.0 or beyond.any():
        # the plane says nothing there: no farther than both can fly towards each other
        h = (one["cos"][k, None] * two["sin"][None, span] - one["sin"][k, None] * two["cos"][None, span]) ** 2
        lon = one["cos_lon"][k, None] * two["sin_lon"][None, span] - one["sin_lon"][k, None] * two["cos_lon"][None, span]
        h += (one["cos"][k, None] ** 2 - one["sin"][k, None] ** 2) * (two["cos"][None, span] ** 2 - two["sin"][None, span] ** 2) * lon**2
        reached = 2 * LEAST_M * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0))) * 0.99 <= ZONE_M + AHEAD_S * np.sqrt(dv2) + 1e4
        found = np.where(beyond | (outer > 80.0), reached, found)
    # heights meet within the look-ahead, or are near already; one that is not known rules nothing out
    rise, later = between("alt"), between("vs")
    later *= np.float32(AHEAD_S)
    later += rise
    found &= ~((np.minimum(rise, later) > HEIGHT_M + 1.0) | (np.maximum(rise, later) < -HEIGHT_M - 1.0))
    return found


def met(a: Side, b: Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both sides of the pairs that may be conflicts."""
    for side in (a,) if same else (a, b):
        small(side)
    for k, span in B.strips(a, b, same):
        pairs, kept = B.together(a, b, same, k, span), candidates(a, b, k, span)
        i, j = np.nonzero(kept if pairs is None else kept & pairs)
        if len(i):
            yield i + k.start, j + span.start


def taken(side: Side, at: np.ndarray, of: str = "") -> Terms:
    return {n: side[of + n][at] for n in ("lat", "lon", "alt", "vs", "u", "v")}


def directed(table: pa.Table) -> Iterator[tuple[Side, np.ndarray, Side, np.ndarray, Terms]]:
    """``one, i, two, j`` and terms of directed conflicts, both orders of some pairs after each other."""
    a, b, same = B.sides(table)
    for i, j in met(a, b, same):
        one, two = taken(a, i), taken(b, j)
        for first, p, second, q, of_first, of_second in ((a, i, b, j, one, two), (b, j, a, i, two, one)):
            kept, t = terms(of_first, of_second)
            yield first, p[kept], second, q[kept], {n: v[kept] for n, v in t.items()}


def conflict_rows(states: DataFrame) -> DataFrame:
    """``tick, id1, id2, qdr, dist_m, tcpa, tinconf`` of directed conflicts."""
    names = ("qdr", "dist_m", "tcpa", "tinconf")

    def rows(table: pa.Table) -> Iterator[Terms]:
        for one, i, two, j, t in directed(table):
            if len(i):
                yield {"id1": one["id"][i], "id2": two["id"][j], **{n: t[n] for n in names}}

    return B.meet_rows(states, conflict_columns(), rows, B.pair_schema(**dict.fromkeys(names, pa.float64())))


def either(one: Terms, two: Terms) -> np.ndarray:
    """Which pairs are in conflict in either order; the other order is asked only where the first is none."""
    kept = terms(one, two)[0]
    rest = np.flatnonzero(~kept)
    kept[rest] = terms(*({n: v[rest] for n, v in side.items()} for side in (two, one)))[0]
    return kept


def in_conflict(table: pa.Table) -> Iterator[tuple[Side, np.ndarray, Side, np.ndarray]]:
    """``a, i, b, j`` of pairs that are in conflict in either order, each once."""
    a, b, same = B.sides(table)
    for i, j in met(a, b, same):
        kept = either(taken(a, i), taken(b, j))
        if kept.any():
            yield a, i[kept], b, j[kept]


def conflict_pairs(states: DataFrame) -> DataFrame:
    """``tick, low, high`` of pairs that are in conflict in either order, each once."""

    def rows(table: pa.Table) -> Iterator[Terms]:
        for a, i, b, j in in_conflict(table):
            yield {"id1": np.minimum(a["id"][i], b["id"][j]), "id2": np.maximum(a["id"][i], b["id"][j])}

    return B.meet_rows(states, conflict_columns(), rows, B.pair_schema()).withColumnsRenamed({"id1": "low", "id2": "high"})


def with_last(states: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """States, a row an aircraft and tick, with the columns of conflicts now and, if the aircraft was there, in the tick before, as ``last_...``."""
    columns = conflict_columns()
    before = F.lag(F.struct("tick", *[v.alias(n) for n, v in columns.items()])).over(Window.partitionBy("trajectory_id").orderBy("tick"))
    states = states.withColumn("before", before)
    there = c("before.tick") == c("tick") - 1
    last = {f"last_{n}": F.when(there, c(f"before.{n}")) for n in columns}
    return states, columns | last | {"was": F.coalesce(there, F.lit(False))}


def fresh(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Which pairs in conflict were not in one in the tick before."""
    new = np.ones(len(i), bool)
    both = np.flatnonzero(a["was"][i] & b["was"][j])
    new[both] = ~either(taken(a, i[both], "last_"), taken(b, j[both], "last_"))
    return new


def fresh_pairs(states: DataFrame) -> DataFrame:
    """``conflict_pairs`` that were not in conflict in the tick before, told from both states there, so that no pair is looked up."""
    states, columns = with_last(states)

    def rows(table: pa.Table) -> Iterator[Terms]:
        for a, i, b, j in in_conflict(table):
            new = fresh(a, i, b, j)
            ids = a["id"][i[new]], b["id"][j[new]]
            yield {"id1": np.minimum(*ids), "id2": np.maximum(*ids)}

    return B.meet_rows(states, columns, rows, B.pair_schema()).withColumnsRenamed({"id1": "low", "id2": "high"})


def conflict_counts(states: DataFrame) -> DataFrame:
    """``tick, n_now, n_new``: how many pairs of a tick are in conflict, and how many were not in the tick before; ticks without any have no row."""
    states, columns = with_last(states)
    schema = pa.schema([("tick", pa.int64()), ("n_now", pa.int64()), ("n_new", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        now, new = 0, 0
        for a, i, b, j in in_conflict(table):
            now, new = now + len(i), new + np.count_nonzero(fresh(a, i, b, j))
        return B.result(table, schema, **({"n_now": [now], "n_new": [new]} if now else {"n_now": [], "n_new": []}))

    return B.meet_blocks(states, columns, run, "tick long, n_now long, n_new long").groupBy("tick").agg(F.sum("n_now").alias("n_now"), F.sum("n_new").alias("n_new"))


def conflict_vectors(states: DataFrame, margin: float = 1.05) -> DataFrame:
    """``tick, trajectory_id, dve_mps, dvn_mps, n_conflicts`` as ``pairs.resolution_vectors`` gives them."""
    schema = pa.schema([("tick", pa.int64()), ("trajectory_id", pa.int64()), ("dve_mps", pa.float64()), ("dvn_mps", pa.float64()), ("n_conflicts", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        found: dict[int, tuple[Side, np.ndarray, np.ndarray, np.ndarray]] = {}
        for one, i, _, _, t in directed(table):
            m = len(one["id"])
            _, east, north, n = found.setdefault(id(one["id"]), (one, np.zeros(m), np.zeros(m), np.zeros(m, np.int64)))
            cx, cy = t["dx"] + t["du"] * t["tcpa"], t["dy"] + t["dv"] * t["tcpa"]
            miss = np.maximum(np.sqrt(cx * cx + cy * cy), 10.0)
            push = (ZONE_M * margin - miss) / np.maximum(np.abs(t["tcpa"]), 1.0) / miss
            east += np.bincount(i, -push * cx, m)
            north += np.bincount(i, -push * cy, m)
            n += np.bincount(i, minlength=m)
        parts = [[x[n > 0] for x in (one["id"], east, north, n)] for one, east, north, n in found.values()]
        made = list(map(np.concatenate, zip(*parts))) if parts else [[]] * 4
        return B.result(table, schema, **dict(zip(schema.names[1:], made)))

    found = B.meet_blocks(states, conflict_columns(), run, "tick long, trajectory_id long, dve_mps double, dvn_mps double, n_conflicts long")
    return found.groupBy("tick", "trajectory_id").agg(*[F.sum(n).alias(n) for n in ("dve_mps", "dvn_mps", "n_conflicts")])
