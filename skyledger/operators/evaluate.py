"""Scoring of system commands against historical instructions, of command execution and of separation changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import text

EVENT = ("event_id", "callsign", "family", "target", "unit", "epoch")


def canonical(rows: DataFrame, callsign: list[str], family: list[str], epoch: Column) -> DataFrame:
    """``rows`` with normalised ``callsign``, ``family`` and ``epoch`` from the first columns that have a value, and
    ``valid``: whether all three are known. Nothing is dropped, so invalid rows can be counted or raised on."""
    names = text.callsign(F.coalesce(*[F.col(c) for c in callsign]))
    kinds = text.family(F.coalesce(*[F.col(c) for c in family]))
    out = rows.withColumns({"__c": names, "__f": kinds, "__t": epoch}).drop("callsign", "family", "epoch")
    out = out.withColumnsRenamed({"__c": "callsign", "__f": "family", "__t": "epoch"})
    return out.withColumn("valid", F.col("callsign").isNotNull() & F.col("family").isNotNull() & F.col("epoch").isNotNull())


def in_islands(refs: DataFrame, own: DataFrame, window_s: float, keys: list[str]) -> DataFrame:
    """Events of both sides with ``side`` and ``island``, a stretch of time without an empty interval as wide as the window.

    No match can cross an empty interval, so islands are matched apart from each other without changing the result.
    They are found from the occupied intervals alone, which are an aggregate of the events; a key of any number of events
    is spread over its intervals, and islands with events of one side only are left out before events are shuffled.
    """
    both = refs.select(*EVENT, F.lit(0).alias("side")).unionByName(own.select(*EVENT, F.lit(1).alias("side")))
    both = both.withColumn("interval", F.floor(F.col("epoch") / max(window_s, 1e-6)))
    occupied = both.groupBy(*keys, "interval").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    order = Window.partitionBy(*keys).orderBy("interval")
    starts = F.coalesce((F.col("interval") - F.lag("interval").over(order) > 1).cast("long"), F.lit(1).cast("long"))
    marked = occupied.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
    whole = Window.partitionBy(*keys, "island")
    marked = marked.withColumns({"low": F.min("low").over(whole), "high": F.max("high").over(whole)}).where("low < high")
    return both.join(marked.select(*keys, "interval", "island"), [*keys, "interval"]).drop("interval")


MATCH = "callsign string, family string, ref_id long, sys_id long, delta_s double, ref_target double, sys_target double, ref_unit string, sys_unit string"


Pick = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], list[tuple[int, int]]]


def _grouped(refs: DataFrame, own: DataFrame, window_s: float, keys: list[str], pick: Pick) -> DataFrame:
    """Matches of all islands. A task reads its islands one after another in order, and matches those that a batch ends
    as slices of its columns; it holds a batch and an island at most."""
    group = [*keys, "island"]

    def matches(rows: pd.DataFrame) -> pd.DataFrame:
        columns = {c: rows[c].to_numpy() for c in (*EVENT, "side")}
        starts = np.flatnonzero(_changes(rows, group))
        left, right = [], []
        for low, high in zip(starts, [*starts[1:], len(rows)]):
            sides = [low + np.flatnonzero(columns["side"][low:high] == side) for side in (0, 1)]
            found = pick(*({c: x[at] for c, x in columns.items()} for at in sides))
            left += [sides[0][i] for i, _ in found]
            right += [sides[1][j] for _, j in found]
        a, b = ({c: x[at] for c, x in columns.items()} for at in (np.array(left, np.int64), np.array(right, np.int64)))
        delta = np.abs(a["epoch"].astype(float) - b["epoch"].astype(float))
        values = (a["callsign"], a["family"], a["event_id"], b["event_id"], delta, a["target"], b["target"], a["unit"], b["unit"])
        return pd.DataFrame(dict(zip([x.split()[0] for x in MATCH.split(", ")], values)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = int(np.flatnonzero(_changes(batch, group))[-1])
            if held and not last and _same_key(held[-1], batch, group):
                held.append(batch)
                continue
            if held or last:
                yield matches(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
            held = [batch.iloc[last:]]
        if held:
            yield matches(pd.concat(held, ignore_index=True))

    dealt = in_islands(refs, own, window_s, keys).repartition(*group).sortWithinPartitions(*group, "epoch", "event_id")
    return dealt.mapInPandas(run, MATCH)


def _changes(rows: pd.DataFrame, group: list[str]) -> np.ndarray:
    """True for the first row of each group."""
    out = np.ones(len(rows), bool)
    out[1:] = False
    for c in group:
        x = rows[c].to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def _same_key(before: pd.DataFrame, after: pd.DataFrame, group: list[str]) -> bool:
    return all(before[c].iloc[-1] == after[c].iloc[0] for c in group)


def _agrees(a: dict[str, np.ndarray], b: dict[str, np.ndarray], i: int, at: slice) -> np.ndarray:
    """Which of the commands ``at`` have the target of reference ``i``, in its unit."""
    limit = text.TOLERANCE.get(f"{a['family'][i]} {a['unit'][i]}", np.nan)
    gap = np.abs(float(a["target"][i]) - b["target"][at].astype(float))
    if a["family"][i] == "heading":
        gap = np.abs((gap + 180.0) % 360.0 - 180.0)
    return (gap <= limit) & (b["unit"][at] == a["unit"][i])


class Chain:
    """For prefixes of the commands, the best chain of pairs that ends in them: most pairs, then least seconds.

    References come in order of time, so the commands in their window move on only: those before it are done with, and
    those after it have the chain of the last command seen. A step therefore costs its window, not all commands.
    Seconds are counted in billionths, so that sums are exact and ties are ties.
    """

    def __init__(self, commands: int):
        self.pairs, self.time, self.last = [0] * (commands + 1), [0] * (commands + 1), [-1] * (commands + 1)
        self.seen = 0
        self.links: list[tuple[int, int, int]] = []

    def add(self, i: int, low: int, high: int, fits: list[bool], delta: list[int]) -> None:
        """Reference ``i`` may be paired with those of the commands from ``low`` to ``high`` that ``fits`` tells."""
        pairs, time, last = self.pairs, self.time, self.last
        for c in range(self.seen, high):
            pairs[c + 1], time[c + 1], last[c + 1] = pairs[c], time[c], last[c]
        self.seen = max(self.seen, high)
        most, least, link = -1, 0, -1  # the reference's best pair so far; the first of equals
        before, spent, chain = pairs[low], time[low], last[low]
        for c, fit, gap in zip(range(low, self.seen), fits, delta):
            if fit and (before + 1 > most or (before + 1 == most and spent + gap < least)):
                most, least, link = before + 1, spent + gap, len(self.links)
                self.links.append((i, c, chain))
            before, spent, chain = pairs[c + 1], time[c + 1], last[c + 1]
            if most > before or (most == before and least < spent):
                pairs[c + 1], time[c + 1], last[c + 1] = most, least, link

    def traced(self) -> list[tuple[int, int]]:
        out, at = [], self.last[self.seen]
        while at >= 0:
            i, j, at = self.links[at]
            out.append((i, j))
        return out[::-1]


def _columns(rows: pd.DataFrame | dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return rows if isinstance(rows, dict) else {c: rows[c].to_numpy() for c in rows.columns}


def ordered_pairs(a: pd.DataFrame | dict[str, np.ndarray], b: pd.DataFrame | dict[str, np.ndarray], window_s: float, strict: bool) -> list[tuple[int, int]]:
    """Places of the one-to-one pairs in time order that are most, and of these those with the least total time difference.

    Of equally good ways the last pair has the earliest reference, then the earliest command; so has the one before it.
    Both sides are in order of time.
    """
    a, b = _columns(a), _columns(b)
    mine, theirs = a["epoch"].astype(float), b["epoch"].astype(float)
    own, families, chain = a["family"], b["family"], Chain(len(theirs))
    low, high = (np.searchsorted(theirs, mine + d).tolist() for d in (-window_s - 1e-6, window_s + 1e-6))
    for i in range(len(mine)):
        at = slice(low[i], high[i])
        delta = np.abs(mine[i] - theirs[at])
        fits = (delta <= window_s) & (families[at] == own[i])
        if strict:
            fits &= _agrees(a, b, i, at)
        if fits.any():
            chain.add(i, low[i], high[i], fits.tolist(), np.rint(delta * 1e9).astype(np.int64).tolist())
    return chain.traced()


def match_ordered(refs: DataFrame, own: DataFrame, window_s: float = 60.0, strict: bool = False) -> DataFrame:
    """Order-preserving one-to-one matches by aircraft, family and time."""
    return _grouped(refs, own, window_s, ["callsign"], lambda a, b: ordered_pairs(a, b, window_s, strict))


def _free(towards: np.ndarray, at: int) -> int:
    """The nearest free place from ``at`` on in one direction; the way there is shortened for later searches."""
    end = at
    while towards[end] != end:
        end = towards[end]
    while towards[at] != end:
        towards[at], at = end, towards[at]
    return int(end)


def greedy_pairs(a: pd.DataFrame | dict[str, np.ndarray], b: pd.DataFrame | dict[str, np.ndarray], window_s: float) -> list[tuple[int, int]]:
    """Places of pairs: references in order of time, each with the nearest command that is still free; ties go to the
    earlier one. Both sides are in order of time. A reference costs a search of its place, not all commands."""
    mine, theirs = (_columns(x)["epoch"].astype(float) for x in (a, b))
    n, out = len(theirs), []
    before, after = np.arange(n + 1), np.arange(n + 1)  # of the first k commands, and from the k-th on: the nearest free one
    for i, (t, place) in enumerate(zip(mine, np.searchsorted(theirs, mine))):
        left, right = _free(before, place) - 1, _free(after, place)
        gap_left = t - theirs[left] if left >= 0 else np.inf
        gap_right = theirs[right] - t if right < n else np.inf
        if min(gap_left, gap_right) <= window_s:
            # of commands at one time the first free one
            j = _free(after, int(np.searchsorted(theirs, theirs[left]))) if gap_left <= gap_right else right
            out.append((i, j))
            before[j + 1], after[j] = j, j + 1
    return out


def match_greedy(refs: DataFrame, own: DataFrame, window_s: float = 60.0) -> DataFrame:
    """One-to-one matches by aircraft and family: references in order of time, each with the nearest free command."""
    return _grouped(refs, own, window_s, ["callsign", "family"], lambda a, b: greedy_pairs(a, b, window_s))


def candidates(refs: DataFrame, own: DataFrame, window_s: float) -> DataFrame:
    """All (reference, command) within the window, by an equi-join on time buckets as wide as the window."""
    left = refs.select("callsign", "family", F.col("event_id").alias("ref_id"), F.col("epoch").alias("ref_epoch"), F.col("target").alias("ref_target"), F.col("unit").alias("ref_unit"))
    left = left.withColumn("bucket", F.floor(F.col("ref_epoch") / window_s))
    right = own.select("callsign", "family", F.col("event_id").alias("sys_id"), F.col("epoch").alias("sys_epoch"), F.col("target").alias("sys_target"), F.col("unit").alias("sys_unit"))
    at = F.floor(F.col("sys_epoch") / window_s)
    right = right.withColumn("bucket", F.explode(F.array(at - 1, at, at + 1)))
    found = left.join(right, ["callsign", "family", "bucket"]).where(F.abs(F.col("ref_epoch") - F.col("sys_epoch")) <= window_s)
    return found.withColumn("delta_s", F.abs(F.col("ref_epoch") - F.col("sys_epoch"))).drop("bucket")


def ratio(a: Column, b: Column) -> Column:
    """A share to six places, half to even; null if there is nothing to share."""
    return F.when(b > 0, F.bround(a / b, 6))


def recall_per_aircraft(refs: DataFrame, own: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts, recall and precision of every aircraft on either side; recall is null without references."""
    each = lambda df, name: df.groupBy("callsign").agg(F.count("*").alias(name))
    out = each(refs, "references").join(each(own, "outputs"), "callsign", "full").join(each(matches, "matched"), "callsign", "left")
    out = out.fillna(0, ["references", "outputs", "matched"])
    return out.withColumns({"recall": ratio(F.col("matched"), F.col("references")), "precision": ratio(F.col("matched"), F.col("outputs"))})


def recall_by_family(refs: DataFrame, own: DataFrame, matches: DataFrame) -> DataFrame:
    each = lambda df, name: df.groupBy("family").agg(F.count("*").alias(name))
    out = each(refs, "references").join(each(own, "outputs"), "family", "full").join(each(matches, "matched"), "family", "left")
    out = out.fillna(0, ["references", "outputs", "matched"])
    return out.withColumns({"recall": ratio(F.col("matched"), F.col("references")), "precision": ratio(F.col("matched"), F.col("outputs"))})


def recall_summary(refs: DataFrame, own: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: the mean of the aircraft's rounded recalls, and the shares over all events."""
    by = recall_per_aircraft(refs, own, matches)
    counted = by.agg(F.bround(F.avg(F.when(F.col("references") > 0, F.col("recall"))), 6).alias("macro_recall"), *[F.sum(c).alias(c) for c in ("references", "outputs", "matched")])
    return counted.select(
        "macro_recall", "references", "outputs", "matched", ratio(F.col("matched"), F.col("references")).alias("micro_recall"),
        ratio(F.col("matched"), F.col("outputs")).alias("precision"), ratio(F.col("outputs"), F.col("references")).alias("inflation"),
    )


MACROS = ((1, "resume"), (2, "heading"), (3, "altitude"), (4, "speed"))


def execution_outcomes(events: DataFrame) -> DataFrame:
    """Command events with ``outcome``: accepted, rejected, or one of two kinds that don't count as submitted."""
    known = events.where(F.col("macro_action").isin(*[m for m, _ in MACROS]))
    empty = F.coalesce(F.col("command"), F.lit("")).isin("", "NOOP")
    outcome = F.when((F.col("event") == "action_executed") & F.col("command_applied"), "accepted")
    outcome = outcome.when(F.col("event") == "action_executed", "no_new_command")
    outcome = outcome.when((F.col("event") == "command_failed") & empty, "precheck_rejected").when(F.col("event") == "command_failed", "rejected")
    return known.withColumn("outcome", outcome).where("outcome is not null")


def counts(*outcomes: str) -> Column:
    return F.count_if(F.col("outcome").isin(*outcomes))


def acceptance_by_macro(events: DataFrame) -> DataFrame:
    """A row for each of the four kinds of action, also for those that never occurred."""
    names = events.sparkSession.createDataFrame(MACROS, "macro_action long, name string")
    found = execution_outcomes(events).groupBy("macro_action").agg(counts("accepted").alias("accepted"), counts("rejected").alias("rejected"))
    out = names.join(found, "macro_action", "left").fillna(0, ["accepted", "rejected"]).withColumn("submitted", F.col("accepted") + F.col("rejected"))
    return out.withColumn("rate", F.when(F.col("submitted") > 0, F.round(F.col("accepted") / F.col("submitted"), 9)))


def separation_changes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Changes of the separation minimum with the outcome of their episode, and why one does not count as a success."""
    last = Window.partitionBy("episode").orderBy(F.desc("row_id"))
    newest = outcomes.where("episode is not null").withColumn("n", F.row_number().over(last)).where("n = 1").select("episode", "safe_success")
    found = events.where("event = 'separation_updated'").join(newest, "episode", "left")
    old, new = F.col("previous_horizontal_km") / 1.852, F.col("horizontal_km") / 1.852
    kind = F.when(new > old, "tightened").when(new < old, "relaxed").otherwise("unchanged")
    known = F.col("safe_success").isNotNull()
    found = found.withColumns({"change": kind, "old_nm": old, "new_nm": new})
    eligible = known & (F.col("change") != "unchanged")
    success = eligible & (F.col("safe_success") == 1)
    reason = F.when(~known, "no diagnostics").when(~eligible, "no change").when(~success, "not safe").otherwise("")
    return found.withColumns({"eligible": eligible, "success": F.coalesce(success, F.lit(False)), "why_not": reason})
