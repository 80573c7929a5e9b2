"""Counts, first ones and bands of a tick's traffic over blocks of its aircraft, as ``blocks`` has them, and rows of pairs within a radius."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import blocks as B
from skyledger.operators.blocks import FT_M, Side

c = F.col


def approach_counts(states: DataFrame, gate_nm: float, height_m: float, horizon_s: float = 300.0) -> DataFrame:
    """``tick, n``: how many pairs of a tick come under the gate by their closest approach while their heights differ by less."""
    schema = pa.schema([("tick", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = B.sides(table, "alt")
        n = 0
        for k, span in B.strips(a, b, same, height_m * 1.001):
            kept = (B.approach(a, b, k, span, horizon_s)[2] < gate_nm) & (np.abs(a["alt"][k, None] - b["alt"][None, span]) < height_m)
            pairs = B.together(a, b, same, k, span)
            n += np.count_nonzero(kept if pairs is None else kept & pairs)
        return B.result(table, schema, n=[n] if n else [])

    return B.meet_blocks(states, B.motion_columns(), run, "tick long, n long").groupBy("tick").agg(F.sum("n").alias("n"))


def convergence(states: DataFrame, gate_nm: float, horizon_s: float = 300.0) -> DataFrame:
    """``tick, convergence, n``: the sum of the roots of 2 and the squared closest approach of the pairs that still come nearer, to under the gate."""
    schema = pa.schema([("tick", pa.int64()), ("convergence", pa.float64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = B.sides(table)
        total, n = 0.0, 0
        for k, span in B.strips(a, b, same):
            _, tcpa, cpa = B.approach(a, b, k, span, horizon_s)
            kept = (cpa < gate_nm) & (tcpa > 0)
            pairs = B.together(a, b, same, k, span)
            cpa = cpa[kept if pairs is None else kept & pairs]
            total, n = total + float(np.sqrt(2.0 + cpa * cpa).sum()), n + len(cpa)
        return B.result(table, schema, **({"convergence": [total], "n": [n]} if n else {"convergence": [], "n": []}))

    return B.meet_blocks(states, B.motion_columns(), run, "tick long, convergence double, n long").groupBy("tick").agg(F.sum("convergence").alias("convergence"), F.sum("n").alias("n"))


def first_approaches(states: DataFrame, gate_nm: float, k: int, horizon_s: float = 300.0) -> DataFrame:
    """``tick, id1, id2, tcpa, now_nm`` of pairs whose closest approach is under the gate: of every two blocks the first ``k`` by time, distance now
    and ids, rounded to four and six digits, among which the first of a tick are."""

    def rows(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        a, b, same = B.sides(table)
        best = {"id1": np.zeros(0, np.int64), "id2": np.zeros(0, np.int64), "tcpa": np.zeros(0), "now_nm": np.zeros(0)}
        for at, span in B.strips(a, b, same):
            now, tcpa, cpa = B.approach(a, b, at, span, horizon_s)
            kept = cpa < gate_nm
            pairs = B.together(a, b, same, at, span)
            if pairs is not None:
                kept &= pairs
            if len(best["tcpa"]) == k:
                # what is later than the last one held, or not sooner and farther, has no place
                last, far = best["tcpa"][-1], best["now_nm"][-1]
                kept &= (tcpa < last - 1e-4) | ((tcpa <= last + 1e-4) & (now <= far + 1e-6))
            i, j = np.nonzero(kept)
            if len(i):
                one, two = a["id"][i + at.start], b["id"][j + span.start]
                new = {"id1": np.minimum(one, two), "id2": np.maximum(one, two), "tcpa": tcpa[i, j], "now_nm": now[i, j]}
                best = {n: np.concatenate([v, new[n]]) for n, v in best.items()}
                order = np.lexsort((best["id2"], best["id1"], np.round(best["now_nm"], 6), np.round(best["tcpa"], 4)))[:k]
                best = {n: v[order] for n, v in best.items()}
        if len(best["id1"]):
            yield best

    return B.meet_rows(states, B.motion_columns(), rows, B.pair_schema(tcpa=pa.float64(), now_nm=pa.float64()))


RULES = ("head_on", "overtake", "crossing_right", "crossing_left")
#: Angles are rounded to nine digits, so they reach a limit from half of the last one.
HALF_DIGIT = 5e-10


def rule_columns() -> dict[str, Column]:
    return {"lat": c("lat"), "lon": c("lon"), "trk": c("trk_deg")}


def to_the_right(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bearing of ``b`` from ``a``, less the course of ``a`` and rounded, is under 180 degrees."""
    p1, p2, dl = np.radians(a["lat"][i]), np.radians(b["lat"][j]), np.radians(b["lon"][j] - a["lon"][i])
    bearing = np.degrees(np.arctan2(np.sin(dl) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(dl)))
    return np.round(np.mod(bearing - a["trk"][i], 360.0), 9) < 180.0


def encounter_rules(states: DataFrame) -> DataFrame:
    """``rule, n`` of all ordered pairs of a tick.

    A side is the sign of the product of the other's place, as a vector from the earth's centre, and the direction to the right of the course; where that
    is nearly zero, and for one place, the bearing itself is worked out.
    """
    schema = pa.schema([("tick", pa.int64()), ("kind", pa.int64()), ("n", pa.int64())])
    ahead, along = math.cos(math.radians(160.0 - HALF_DIGIT)), math.cos(math.radians(20.0 + HALF_DIGIT))

    def vectors(side: Side) -> None:
        p, l, t = (np.radians(side[n]) for n in ("lat", "lon", "trk"))
        east, north = np.stack([-np.sin(l), np.cos(l), 0 * l], 1), np.stack([-np.sin(p) * np.cos(l), -np.sin(p) * np.sin(l), np.cos(p)], 1)
        side["place"] = np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)], 1)
        side["right"], side["course"] = np.cos(t)[:, None] * east - np.sin(t)[:, None] * north, np.stack([np.cos(t), np.sin(t)], 1)

    def run(table: pa.Table) -> pa.Table:
        a, b, same = B.sides(table)
        for side in (a,) if same else (a, b):
            vectors(side)
        n = np.zeros(len(RULES), np.int64)
        for k, span in B.strips(a, b, same):
            pairs = B.together(a, b, same, k, span)
            turned = a["course"][k] @ b["course"][span].T
            head_on, overtake = turned <= ahead, turned >= along
            if pairs is not None:
                head_on &= pairs
                overtake &= pairs
            left = ~(head_on | overtake)
            if pairs is not None:
                left &= pairs
            many = np.count_nonzero(left)
            n[:2] += 2 * np.count_nonzero(head_on), 2 * np.count_nonzero(overtake)
            for one, two, at, others in ((a, b, k, span), (b, a, span, k)):
                across = one["right"][at] @ two["place"][others].T
                crossing = left if one is a and at is k else left.T
                doubtful = np.abs(across) < 1e-10
                right = np.count_nonzero(crossing & (across > 0) & ~doubtful)
                i, j = np.nonzero(crossing & doubtful)
                right += np.count_nonzero(to_the_right(one, two, i + at.start, j + others.start))
                n[2:] += right, many - right
        kinds = np.flatnonzero(n)
        return B.result(table, schema, kind=kinds, n=n[kinds])

    found = B.meet_blocks(states, rule_columns(), run, "tick long, kind long, n long")
    return found.groupBy(B.named(RULES, "kind").alias("rule")).agg(F.sum("n").alias("n"))


def copies(ids: np.ndarray) -> np.ndarray:
    """How many rows each row's id has."""
    _, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    return n[at]


def levels_taken(states: DataFrame, levels: tuple[int, ...], height_m: float, near_nm: float, close_nm: float) -> DataFrame:
    """``tick, id1, at, near, close``: for each aircraft and level, by its place in ``levels``, how many others are within ``height_m`` of the level and nearer
    than either distance. Aircraft alone in their tick have no row."""
    names = [f"{n}_{k}" for n in ("near", "close") for k in range(len(levels))]
    schema = pa.schema([("tick", pa.int64()), ("id1", pa.int64()), ("others", pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        a, b, same = B.sides(table)
        there = lambda side: (np.abs(side["alt"][:, None] - np.array(levels, float)) < height_m).astype(np.float32)
        of_a = there(a)
        of_b = of_a if same else there(b)
        sums = lambda side: np.zeros((len(side["id"]), len(names)), np.int64)
        got_a = sums(a)
        got_b = got_a if same else sums(b)
        for k, span in B.strips(a, b, same):
            now, pairs = B.distance_now(a, b, k, span), B.together(a, b, same, k, span)
            for m, reach in enumerate((near_nm, close_nm)):
                kept = now < reach
                kept = (kept if pairs is None else kept & pairs).astype(np.float32)
                columns = slice(m * len(levels), (m + 1) * len(levels))
                got_a[k, columns] += (kept @ of_b[span]).astype(np.int64)
                got_b[span, columns] += (kept.T @ of_a[k]).astype(np.int64)
        both = [(a, got_a, len(a["id"]) - copies(a["id"]))] if same else [(a, got_a, np.full(len(a["id"]), len(b["id"]))), (b, got_b, np.full(len(b["id"]), len(a["id"])))]
        got = np.concatenate([g for _, g, _ in both])
        others = np.concatenate([n for _, _, n in both])
        return B.result(table, schema, id1=np.concatenate([s["id"] for s, _, _ in both]), others=others, **dict(zip(names, got.T)))

    found = B.meet_blocks(states, B.place_columns(), run, "tick long, id1 long, others long, " + ", ".join(f"{n} long" for n in names))
    found = found.groupBy("tick", "id1").agg(F.sum("others").alias("others"), *[F.sum(n).alias(n) for n in names]).where("others > 0")
    each = F.array(*[F.struct(F.lit(k).alias("at"), c(f"near_{k}").alias("near"), c(f"close_{k}").alias("close")) for k in range(len(levels))])
    return found.select("tick", "id1", F.inline(each))


def united(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each row as those of their union: what touches is one."""
    order = np.lexsort((high, low, row))
    row, low, high = row[order], low[order], high[order]
    shift = (row - row[0]) * 1024.0 if len(row) else row
    reach = np.maximum.accumulate(high + shift)
    starts = np.flatnonzero(np.r_[True, (low + shift)[1:] > reach[:-1]]) if len(row) else np.zeros(0, np.int64)
    return row[starts], low[starts], np.maximum.reduceat(high, starts) if len(starts) else high


def bands(states: DataFrame, within_nm: float, height_m: float, wide_nm: float) -> DataFrame:
    """``tick, id1, a, b``: the headings, from its course, of each aircraft that lead towards others near in place and height, within 90 degrees: of every two
    blocks the united bands."""
    schema = pa.schema([("tick", pa.int64()), ("id1", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        tick = table.column("tick")[0].as_py()
        one, two, same = B.sides(table, "alt")
        for a, b in [(one, one)] if same else [(one, two), (two, one)]:
            for k, span in B.strips(a, b, False, height_m * 1.001):
                now = B.distance_now(a, b, k, span)
                kept = (now < within_nm) & (np.abs(a["alt"][k, None] - b["alt"][None, span]) < height_m)
                if same:
                    kept &= a["id"][k, None] != b["id"][None, span]
                i, j = np.nonzero(kept)
                now, i, j = now[i, j], i + k.start, j + span.start
                p1, p2, dl = np.radians(a["lat"][i]), np.radians(b["lat"][j]), np.radians(b["lon"][j] - a["lon"][i])
                bearing = np.degrees(np.arctan2(np.sin(dl) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(dl)))
                half = np.round(np.degrees(np.arcsin(np.minimum(1.0, wide_nm / np.maximum(now, wide_nm)))), 6)
                mid = np.round(np.mod(bearing - a["trk"][i] + 180.0, 360.0) - 180.0, 6)
                met = (mid - half < 90) & (mid + half > -90)
                row, low, high = united(i[met], np.maximum(-90.0, mid - half)[met], np.minimum(90.0, mid + half)[met])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tick)), pa.array(a["id"][row]), pa.array(low), pa.array(high)], schema=schema)

    return B.meet_blocks(states, {**B.place_columns(), "trk": c("trk_deg")}, run, "tick long, id1 long, a double, b double")


def within_radius(states: DataFrame, radius_nm: float) -> DataFrame:
    """``tick, id1, id2, now_nm`` of pairs within a radius, each once."""

    def rows(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        a, b, same = B.sides(table, "lat")
        for k, span in B.strips(a, b, same, radius_nm / 60.0 * 1.001, by="lat"):
            now, pairs = B.distance_now(a, b, k, span), B.together(a, b, same, k, span)
            kept = now <= radius_nm
            i, j = np.nonzero(kept if pairs is None else kept & pairs)
            if len(i):
                one, two = a["id"][i + k.start], b["id"][j + span.start]
                yield {"id1": np.minimum(one, two), "id2": np.maximum(one, two), "now_nm": now[i, j]}

    return B.meet_rows(states, {"lat": c("lat"), "lon": c("lon")}, rows, B.pair_schema(now_nm=pa.float64()))
