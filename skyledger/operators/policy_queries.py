"""Registered queries of candidates, safety and thresholds, of scenes and stores, with their DuckDB twins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import blocks as B
from skyledger.operators import contact_blocks as C
from skyledger.operators import pairs as P
from skyledger.operators import policy as L
from skyledger.operators import traffic_blocks as T
from skyledger.operators.gating import gate_step
from skyledger.operators.pair_queries import _X as CONTACTS
from skyledger.plans import oracle as O
from skyledger.registry import query
from skyledger.sources import adapters as A
from skyledger.sources.tables import table

c = F.col
_STATES = "SELECT *, CASE WHEN event_id % 5 = 0 THEN 'departure' WHEN event_id % 7 = 0 THEN 'arrival' ELSE 'overflight' END AS phase FROM tracks"
_KT = "gs_mps * (3600.0::DOUBLE / 1852.0::DOUBLE)"
_LEVEL = ", ".join(f"('altitude', {x}.0::DOUBLE)" for x in L.LEVELS_M)
_SPEED = ", ".join(f"('speed', {x}.0::DOUBLE)" for x in L.SPEEDS_KT)
_ALL = {
    "st": _STATES,
    "k": f"SELECT * FROM (VALUES ('hold', 0.0::DOUBLE), {_LEVEL}, {_SPEED}) v(kind, target)",
    "e0": f"SELECT st.*, k.kind, k.target, CASE k.kind WHEN 'hold' THEN 0.0::DOUBLE WHEN 'altitude' THEN k.target - alt_m ELSE k.target - {_KT} END AS delta FROM st CROSS JOIN k",
    "e1": """SELECT *, CASE kind WHEN 'hold' THEN 'hold' WHEN 'altitude' THEN CASE WHEN abs(delta) < 50 THEN 'maintain' WHEN delta > 0 THEN 'climb' ELSE 'descend' END
        ELSE CASE WHEN abs(delta) < 5 THEN 'maintain_speed' WHEN delta > 0 THEN 'accelerate' ELSE 'decelerate' END END AS direction,
        CASE kind WHEN 'hold' THEN 'HOLD' WHEN 'altitude' THEN 'ALT_' || CAST(CAST(target AS BIGINT) AS VARCHAR) ELSE 'SPD_' || CAST(CAST(target AS BIGINT) AS VARCHAR) END AS candidate_id FROM e0""",
    "e": "SELECT * FROM e1 WHERE NOT (phase = 'departure' AND direction = 'descend') AND NOT (phase = 'arrival' AND direction = 'climb')",
    "sc": "SELECT *, CAST((event_id * 31 + CAST(target AS BIGINT) * 7) % 1009 AS DOUBLE) / 1009 AS score FROM e",
    "mg": "SELECT *, max(CASE WHEN candidate_id = 'HOLD' THEN score END) OVER (PARTITION BY tick, trajectory_id) AS hold_score FROM sc",
    "bs": "SELECT *, score - hold_score AS margin FROM mg WHERE candidate_id <> 'HOLD' QUALIFY row_number() OVER (PARTITION BY tick, trajectory_id ORDER BY score DESC, candidate_id) = 1",
}


def views(body: str, **more: str) -> str:
    return O.with_views(body, "tracks", **_ALL, **more)


def states(spark, folder) -> DataFrame:
    i = c("event_id")
    return A.tracks(spark, folder).withColumn("phase", F.when(i % 5 == 0, "departure").when(i % 7 == 0, "arrival").otherwise("overflight"))


def score(target: Column) -> Column:
    """A candidate's score by integer arithmetic."""
    return ((c("event_id") * 31 + target.cast("long") * 7) % 1009).cast("double") / 1009


def scored(spark, folder) -> DataFrame:
    """Candidates with their score, a row each."""
    e = L.expand(states(spark, folder)).select("*", "k.kind", "k.target", "k.direction", "k.delta").drop("k")
    return e.withColumn("score", score(c("target")))


def ordered(spark, folder) -> DataFrame:
    """States with their scored candidates in order, a row a state."""
    return L.in_order(states(spark, folder), score)


def with_all(ordered: DataFrame) -> DataFrame:
    """``all``: the candidates in order, holding among them."""
    return P.once(ordered, {"all": F.sort_array(F.concat("ranked", F.array("hold")))})


@query("expand_candidates", views("SELECT event_id, candidate_id, direction, round(delta, 6) AS delta FROM e"))
def expand_candidates(spark, folder):
    return scored(spark, folder).select("event_id", "candidate_id", "direction", F.round("delta", 6).alias("delta"))


@query("expand_level_actions", views("SELECT event_id, candidate_id, row_number() OVER (PARTITION BY event_id ORDER BY abs(delta), candidate_id) AS preference FROM e WHERE kind <> 'speed'"))
def expand_level_actions(spark, folder):
    """Holding and levels of each state, the smallest change first."""
    each = F.transform(F.filter("all", lambda k: k["kind"] != "speed"), lambda k: F.struct(F.abs(k["delta"]).alias("by"), k["candidate_id"].alias("candidate_id")))
    ranked = with_all(ordered(spark, folder)).select("event_id", F.posexplode(F.sort_array(each)).alias("at", "k"))
    return ranked.select("event_id", "k.candidate_id", (c("at") + 1).alias("preference"))


@query("hold_margin", views("SELECT event_id, candidate_id, round(score - hold_score, 9) AS margin FROM mg"))
def hold_margin(spark, folder):
    each = with_all(ordered(spark, folder)).select("event_id", "hold", F.explode("all").alias("k"))
    return each.select("event_id", "k.candidate_id", F.round(c("k.score") - c("hold.score"), 9).alias("margin"))


@query("best_candidate", views("SELECT event_id, CASE WHEN margin >= 0.25 THEN candidate_id ELSE 'HOLD' END AS chosen, round(margin, 9) AS margin FROM bs"))
def best_candidate(spark, folder):
    b = L.first_choice(ordered(spark, folder))
    return b.select("event_id", F.when(c("margin") >= 0.25, c("candidate_id")).otherwise("HOLD").alias("chosen"), F.round("margin", 9).alias("margin"))


@query("top_k_candidates", views("SELECT event_id, candidate_id, row_number() OVER (PARTITION BY tick, trajectory_id ORDER BY score DESC, candidate_id) AS rank FROM mg WHERE candidate_id <> 'HOLD' QUALIFY rank <= 5"))
def top_k_candidates(spark, folder):
    first = ordered(spark, folder).select("event_id", F.posexplode(F.slice("ranked", 1, 5)).alias("at", "k"))
    return first.select("event_id", "k.candidate_id", (c("at") + 1).alias("rank"))


@query("one_command_per_tick", views("SELECT tick, trajectory_id, candidate_id FROM bs WHERE margin >= 0.25 QUALIFY row_number() OVER (PARTITION BY tick ORDER BY round(margin, 9) DESC, score DESC, candidate_id, trajectory_id) = 1"))
def one_command_per_tick(spark, folder):
    b = L.first_choice(ordered(spark, folder)).where("margin >= 0.25")
    order = Window.partitionBy("tick").orderBy(F.desc(F.round("margin", 9)), F.desc("score"), "candidate_id", "trajectory_id")
    return b.withColumn("n", F.row_number().over(order)).where("n = 1").select("tick", "trajectory_id", "candidate_id")


_TRUE = "CASE WHEN event_id % 3 = 0 THEN candidate_id WHEN event_id % 3 = 1 THEN 'HOLD' ELSE 'ALT_9900' END"


def decided(spark, folder) -> DataFrame:
    b = L.first_choice(ordered(spark, folder))
    i = c("event_id")
    return b.select("event_id", F.when(i % 3 == 0, c("candidate_id")).when(i % 3 == 1, "HOLD").otherwise("ALT_9900").alias("truth"), c("candidate_id").alias("best"), F.round("margin", 9).alias("margin"))


_MET = """SELECT threshold, round(sum(CASE WHEN pos AND said AND best = truth THEN 1 ELSE 0 END) / count_if(pos), 9) AS positive_exact, round(count_if(pos AND said AND split_part(best, '_', 1) = split_part(truth, '_', 1)) / count_if(pos), 9) AS positive_family,
    round(count_if(NOT pos AND NOT said) / count_if(NOT pos), 9) AS hold_specificity, round(CASE WHEN count_if(said) > 0 THEN count_if(said AND pos) / count_if(said) ELSE 0 END, 9) AS precision, round(count_if(said AND pos) / count_if(pos), 9) AS recall
    FROM (SELECT d.*, t.threshold, margin >= threshold AS said, truth <> 'HOLD' AS pos FROM d CROSS JOIN t) GROUP BY threshold"""


@query("threshold_metrics", views(_MET, d=f"SELECT event_id, {_TRUE} AS truth, candidate_id AS best, round(margin, 9) AS margin FROM bs", t="SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM range(-10, 11) r(i)"))
def threshold_metrics(spark, folder):
    t = spark.range(-10, 11).select((c("id").cast("double") / 10).alias("threshold"))
    m = L.threshold_metrics(decided(spark, folder), t)
    return m.select("threshold", *[F.round(x, 9).alias(x) for x in L.METRICS[:5]])


@query("threshold_sweep")
def threshold_sweep(spark, folder):
    """The threshold that does best among 201 quantiles of the margin and two extremes, under limits on precision and on
    the number of commands, or without them if none keeps to them."""
    d = decided(spark, folder)
    at = F.percentile("margin", F.array(*[F.lit(k / 200) for k in range(201)]))
    t = d.agg(F.explode(F.array_distinct(F.concat(at, F.array(F.lit(-1.0), F.lit(1.0))))).alias("threshold"))
    m = L.threshold_metrics(d, t).withColumn("feasible", (c("precision") >= 0.5) & (c("commands") <= 1.5 * c("positives")))
    pick = F.max(F.struct("feasible", "positive_exact", "objective", "precision", "threshold")).alias("b")
    return m.agg(pick).select("b.*")


@query("dataset_profile", views("SELECT phase, count(*) AS rows, count(DISTINCT event_id) AS states, count_if(candidate_id = 'HOLD') AS holds FROM e GROUP BY phase"))
def dataset_profile(spark, folder):
    return scored(spark, folder).groupBy("phase").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("states"), F.count_if(c("candidate_id") == "HOLD").alias("holds"))


_FLOWN = """CASE WHEN kind = 'speed' THEN ((s1 + (s1 + sign(target - s1) * 0.8::DOUBLE * least(abs(target - s1) / 0.8::DOUBLE, r))) * 0.5::DOUBLE * least(abs(target - s1) / 0.8::DOUBLE, r) + target * (r - least(abs(target - s1) / 0.8::DOUBLE, r))) / 3600 ELSE s1 * r / 3600 END"""
_ROLL = {
    "g0": "SELECT p.*, t.t, least(t.t, 10.0::DOUBLE) AS b, greatest(t.t - 10, 0.0::DOUBLE) AS r, gs1 * (3600.0::DOUBLE / 1852.0::DOUBLE) AS s1, gs2 * (3600.0::DOUBLE / 1852.0::DOUBLE) AS s2, CASE WHEN id1 % 2 = 0 THEN 'speed' ELSE 'altitude' END AS kind, CASE WHEN id1 % 2 = 0 THEN 400.0::DOUBLE ELSE 9900.0::DOUBLE END AS target FROM opairs p CROSS JOIN (SELECT CAST(i * 10 AS DOUBLE) AS t FROM range(0, 13) q(i)) t",
    "g1": f"SELECT *, s1 * b / 3600 + {_FLOWN} AS d1, s2 * b / 3600 + s2 * r / 3600 AS d2, alt1 + vs1 * b AS l1, alt2 + vs2 * b + vs2 * r AS z2 FROM g0",
    "g2": """SELECT *, (lon1 - 120.96985) * 60 * cos(radians(30.92095)) + d1 * sin(radians(trk1)) AS x1, (lat1 - 30.92095) * 60 + d1 * cos(radians(trk1)) AS y1, (lon2 - 120.96985) * 60 * cos(radians(30.92095)) + d2 * sin(radians(trk2)) AS x2, (lat2 - 30.92095) * 60 + d2 * cos(radians(trk2)) AS y2,
        CASE WHEN kind = 'altitude' AND r > 0 THEN CASE WHEN target > l1 THEN least(target, l1 + 6 * r) ELSE greatest(target, l1 - 6 * r) END ELSE l1 + vs1 * r END AS z1 FROM g1""",
    "g3": "SELECT tick, id1, id2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS h, abs(z2 - z1) AS v FROM g2",
}


def acting(spark, folder) -> DataFrame:
    """States with the candidate of each aircraft, by its number."""
    even = c("trajectory_id") % 2 == 0
    return A.tracks(spark, folder).withColumns({"kind": F.when(even, "speed").otherwise("altitude"), "target": F.when(even, 400.0).otherwise(9900.0)})


@query("rollout_safety", O.with_views("SELECT tick, id1, id2, round(min(h), 5) AS min_nm, round(min(CASE WHEN h < 5 THEN v END), 4) AS min_m, bool_or(h < 5 AND v < 300) AS unsafe FROM g3 GROUP BY ALL", "opairs", **_ROLL))
def rollout_safety(spark, folder):
    """Each aircraft under a candidate against all others of its tick."""
    return L.rollouts(acting(spark, folder)).select("tick", "id1", "id2", F.round("min_nm", 5).alias("min_nm"), F.round("min_m", 4).alias("min_m"), "unsafe")


@query("unsafe_pairs_cap", O.with_views("SELECT tick, id1, count(*) AS n_unsafe, list_sort(list(id2))[1:20] AS first_unsafe FROM (SELECT tick, id1, id2 FROM g3 GROUP BY ALL HAVING bool_or(h < 5 AND v < 300)) GROUP BY ALL".replace("list_sort(list(id2))[1:20]", "array_to_string(list_sort(list(id2))[1:20], ',')"), "opairs", **_ROLL))
def unsafe_pairs_cap(spark, folder):
    """The first 20 aircraft that a candidate brings too close, and how many there are."""
    u = L.first_unsafe(acting(spark, folder), 20)
    first = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return u.select("tick", "id1", c("n").alias("n_unsafe"), first.alias("first_unsafe"))


@query("level_occupancy", O.with_views("SELECT tick, id1, level, count_if(abs(alt2 - level) < 304.8 AND now_nm < 40) AS near, CASE WHEN count_if(abs(alt2 - level) < 304.8 AND now_nm < 10) > 0 THEN 'blocked' WHEN count_if(abs(alt2 - level) < 304.8 AND now_nm < 40) > 0 THEN 'occupied' ELSE 'free' END AS status FROM (SELECT *, sqrt(pow((lon2 - lon1) * 60 * cos(radians(30.92095)), 2) + pow((lat2 - lat1) * 60, 2)) AS now_nm FROM opairs) CROSS JOIN (SELECT CAST(8100 + 600 * i AS DOUBLE) AS level FROM range(0, 7) r(i)) GROUP BY ALL", "opairs"))
def level_occupancy(spark, folder):
    """How free each level is for each aircraft, by what is near it there."""
    g = T.levels_taken(A.tracks(spark, folder), L.LEVELS_M, 304.8, 40.0, 10.0)
    level = F.get(F.array(*[F.lit(float(x)) for x in L.LEVELS_M]), c("at")).alias("level")
    return g.select("tick", "id1", level, "near", F.when(c("close") > 0, "blocked").when(c("near") > 0, "occupied").otherwise("free").alias("status"))


_REJECT = "callsign string, event_id long, accepted boolean, reason string"


def gate(rows: pd.DataFrame, cooldown_s: float = 7200.0, axis_s: float = 14400.0, memory_s: float = 86400.0) -> pd.DataFrame:
    """Accept or reject one aircraft's candidates in order of time; what is accepted starts the next pauses."""
    state, out = None, []
    for r in rows.sort_values(["epoch", "event_id"]).itertuples():
        state, reason = gate_step(state, r, cooldown_s, axis_s, memory_s)
        out.append((r.callsign, r.event_id, not reason, reason))
    return pd.DataFrame(out, columns=["callsign", "event_id", "accepted", "reason"])


def gated(commands: DataFrame, cooldown_s: float = 7200.0, axis_s: float = 14400.0, memory_s: float = 86400.0) -> DataFrame:
    """``callsign, event_id, accepted, reason`` of all aircraft: a task walks through its aircraft in order of time, batch by
    batch, and carries an aircraft's few numbers on from one batch to the next, so no history has to fit into memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.callsign != name:
                    name, state = r.callsign, None
                state, reason = gate_step(state, r, cooldown_s, axis_s, memory_s)
                out.append((r.callsign, r.event_id, not reason, reason))
            yield pd.DataFrame(out, columns=["callsign", "event_id", "accepted", "reason"])

    return commands.repartition("callsign").sortWithinPartitions("callsign", "epoch", "event_id").mapInPandas(run, _REJECT)


_GATED = """SELECT event_id, callsign, n, true AS accepted, '' AS reason, epoch + 7200 AS any_until, CASE WHEN alt THEN epoch + 14400 ELSE -1.0::DOUBLE END AS ua, CASE WHEN alt THEN -1.0::DOUBLE ELSE epoch + 14400 END AS us,
        CASE WHEN alt THEN target END AS ta, CASE WHEN alt THEN epoch END AS ea, CASE WHEN NOT alt THEN target END AS ts, CASE WHEN NOT alt THEN epoch END AS es FROM k WHERE n = 1
    UNION ALL SELECT event_id, callsign, n, why = '', why, CASE WHEN why = '' THEN epoch + 7200 ELSE any_until END, CASE WHEN why = '' AND alt THEN epoch + 14400 ELSE ua END, CASE WHEN why = '' AND NOT alt THEN epoch + 14400 ELSE us END,
        CASE WHEN why = '' AND alt THEN target ELSE ta END, CASE WHEN why = '' AND alt THEN epoch ELSE ea END, CASE WHEN why = '' AND NOT alt THEN target ELSE ts END, CASE WHEN why = '' AND NOT alt THEN epoch ELSE es END
    FROM (SELECT k.event_id, k.callsign, k.n, k.epoch, k.alt, k.target, w.any_until, w.ua, w.us, w.ta, w.ea, w.ts, w.es, CASE WHEN k.epoch < w.any_until THEN 'aircraft cooldown' WHEN k.epoch < CASE WHEN k.alt THEN w.ua ELSE w.us END THEN 'axis cooldown'
        WHEN coalesce(CASE WHEN k.alt THEN w.ta = k.target AND k.epoch - w.ea < 86400 ELSE w.ts = k.target AND k.epoch - w.es < 86400 END, false) THEN 'repeated target'
        WHEN k.alt AND coalesce((k.phase = 'departure' AND k.target < w.ta) OR (k.phase = 'arrival' AND k.target > w.ta), false) THEN 'regressive altitude'
        WHEN NOT k.alt AND coalesce((w.ts - k.speed) * (k.target - k.speed) < 0, false) THEN 'speed reversal' ELSE '' END AS why FROM k JOIN walk w ON k.callsign = w.callsign AND k.n = w.n + 1)"""


_PHASED = "SELECT *, family = 'altitude' AS alt, CASE event_id % 3 WHEN 0 THEN 'departure' WHEN 1 THEN 'arrival' ELSE 'enroute' END AS phase, CAST(200 + 10 * (event_id % 9) AS DOUBLE) AS speed, row_number() OVER (PARTITION BY callsign ORDER BY epoch, event_id) AS n FROM sys"
#: Walks the commands ``k`` of each aircraft; the streaming gate has the same twin.
GATE_SQL = O.with_views("SELECT callsign, event_id, accepted, reason FROM walk", "sys", k=_PHASED, walk=_GATED).replace("WITH ", "WITH RECURSIVE ", 1)


def with_phase(commands: DataFrame) -> DataFrame:
    """Commands with the phase of flight and the ground speed that the gate looks at."""
    k = c("event_id") % 3
    return commands.withColumns({"phase": F.when(k == 0, "departure").when(k == 1, "arrival").otherwise("enroute"), "ground_speed_kt": (200 + 10 * (c("event_id") % 9)).cast("double")})


@query("cooldown_gate", GATE_SQL)
def cooldown_gate(spark, folder):
    """Commands that the pauses and targets of accepted commands let through, with the reason against the others."""
    own = A.system_commands(spark, folder).select("callsign", "event_id", "family", "target", "epoch")
    return gated(with_phase(own))


# -- scenes and stores --------------------------------------------------------------------------------------------------

_EDGE = "CAST(round_even(abs({w}) / 15, 0) AS BIGINT) || ',' || CAST(round_even(abs(alt1 - alt2) / 0.3048::DOUBLE / 500, 0) AS BIGINT) || ',' || CAST(round_even(tcpa / 30, 0) AS BIGINT)".format(w=O.wrap180("trk1 - trk2"))


def hashed_edges(edges: list, digits: int = 24) -> str:
    """The start of the hash of all edges joined by semicolons; ``edges`` are texts with the number of their copies, in order."""
    h, before = hashlib.sha256(), b""
    for edge, n in edges:
        h.update(before + edge.encode())
        before = b";"
        again = b";" + edge.encode()
        for done in range(1, n, 4096):
            h.update(again * min(4096, n - done))
    return h.hexdigest()[:digits]


def scenes(spark, folder) -> DataFrame:
    """A fingerprint per tick: the sorted, bucketed edges of its conflict graph, without names, hashed.

    Edges are counted by their few kinds, and the text of all of them is hashed piece by piece, so that no row holds it.
    """
    e = B.edge_kinds(A.tracks(spark, folder), 5.0)
    e = e.withColumn("edge", F.concat_ws(",", *[c(x).cast("string") for x in ("turn", "height", "time")]))
    edges = F.sort_array(F.collect_list(F.struct("edge", "n")))
    g = e.groupBy("tick").agg(F.sum("n").alias("n_edges"), edges.alias("edges"), F.round(F.min("min_tcpa"), 4).alias("min_tcpa"))
    return g.withColumn("fingerprint", F.udf(lambda e: hashed_edges(e), "string")("edges")).drop("edges")


_SCENE = {
    "ed": f"SELECT tick, tcpa, {_EDGE} AS edge FROM cpa WHERE cpa_nm < 5 AND abs(alt1 - alt2) / 0.3048::DOUBLE < 1000",
    "scene": "SELECT tick, count(*) AS n_edges, substring(sha256(string_agg(edge, ';' ORDER BY edge)), 1, 24) AS fingerprint, round(min(tcpa), 4) AS min_tcpa FROM ed GROUP BY tick",
}


@query("scene_fingerprint", O.with_views("SELECT tick, n_edges, fingerprint FROM scene", "cpa", **_SCENE))
def scene_fingerprint(spark, folder):
    return scenes(spark, folder).select("tick", "n_edges", "fingerprint")


@query("upsert_scene", O.with_views("SELECT fingerprint, count(*) AS seen, min(tick) AS first_seen, max(tick) AS last_seen FROM scene GROUP BY 1", "cpa", **_SCENE))
def upsert_scene(spark, folder):
    """Merging the later half of the scenes into a store of the earlier half: counts add up, the first sight stays."""
    s = scenes(spark, folder).select("tick", "fingerprint")
    half = lambda cond: s.where(cond).groupBy("fingerprint").agg(F.count("*").alias("seen"), F.min("tick").alias("first_seen"), F.max("tick").alias("last_seen"))
    return merge_by_key(half("tick % 2 = 0"), half("tick % 2 = 1"))


def merge_by_key(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new rows merged in by fingerprint."""
    return store.unionByName(new).groupBy("fingerprint").agg(F.sum("seen").alias("seen"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("mark_scene", O.with_views("SELECT fingerprint, CASE WHEN count_if(tick % 3 = 0) > 0 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN count_if(tick % 3 = 0) > 0 THEN 'tick ' || CAST(max(CASE WHEN tick % 3 = 0 THEN tick END) AS VARCHAR) ELSE '' END AS reason FROM scene GROUP BY 1", "cpa", **_SCENE))
def mark_scene(spark, folder):
    """A store of pending scenes, those of every third tick marked as failed, the last mark counting."""
    s = scenes(spark, folder).select("tick", "fingerprint")
    marks = s.where("tick % 3 = 0").select("fingerprint", c("tick").alias("turn"), F.lit("failed").alias("status"), F.concat(F.lit("tick "), c("tick").cast("string")).alias("reason"))
    return marked(s.select("fingerprint", F.lit("pending").alias("status"), F.lit("").alias("reason")).distinct(), marks)


def marked(store: DataFrame, marks: DataFrame, longest: int = 2000) -> DataFrame:
    """The store with the status and the reason of each scene's last mark by ``turn``; marks of unknown scenes are left out."""
    last = marks.groupBy("fingerprint").agg(F.max_by(F.struct("status", F.substring("reason", 1, longest).alias("reason")), "turn").alias("m"))
    joined = store.join(last, "fingerprint", "left")
    return joined.select("fingerprint", F.coalesce("m.status", "status").alias("status"), F.coalesce("m.reason", "reason").alias("reason"))


@query("upsert_plan", O.with_views("SELECT fingerprint, CASE WHEN t IS NULL THEN 'pending' ELSE 'resolved' END AS status, 'plan ' || CAST(t % 1000000000 AS VARCHAR) AS proposal FROM (SELECT fingerprint, max(CASE WHEN n_edges > 1 THEN (tick % 2) * 1000000000 + tick END) AS t FROM scene GROUP BY 1)", "cpa", **_SCENE))
def upsert_plan(spark, folder):
    """Plans for scenes of several conflicts, those of odd ticks saved after those of even ones, and what becomes of the scenes."""
    s = scenes(spark, folder).select("tick", "fingerprint", "n_edges")
    plans = s.where("n_edges > 1").select("fingerprint", c("tick").alias("turn"), F.concat(F.lit("plan "), c("tick").cast("string")).alias("proposal"))
    store = saved_plans(None, plans.where("turn % 2 = 0"))
    store = saved_plans(store, plans.where("turn % 2 = 1"))
    queue = s.select("fingerprint", F.lit("pending").alias("status"), F.lit("").alias("reason")).distinct()
    return resolved(queue, store).join(store.select("fingerprint", "proposal"), "fingerprint", "left").select("fingerprint", "status", "proposal")


def saved_plans(store: DataFrame | None, new: DataFrame) -> DataFrame:
    """``fingerprint, proposal, validation_status`` of the store with new plans put in: the last by ``turn`` of a scene's new
    plans takes the place of the one that it had. A plan without a fingerprint belongs to no scene and is left out."""
    last = new.where("fingerprint is not null").groupBy("fingerprint").agg(F.max_by("proposal", "turn").alias("proposal"))
    last = last.withColumn("validation_status", F.lit("prediction_validated"))
    return last if store is None else store.join(last.select("fingerprint"), "fingerprint", "left_anti").unionByName(last)


def resolved(queue: DataFrame, plans: DataFrame) -> DataFrame:
    """The queue of scenes with those marked ``resolved`` for which a plan is saved; reasons stay."""
    done = plans.select("fingerprint", F.lit(True).alias("planned")).distinct()
    joined = queue.join(done, "fingerprint", "left")
    return joined.select("fingerprint", F.when(c("planned"), "resolved").otherwise(c("status")).alias("status"), "reason")


@query("store_summary", O.with_views("SELECT count(DISTINCT fingerprint) AS scenes, count_if(n_edges > 10) AS dense, count(*) AS sightings FROM scene", "cpa", **_SCENE))
def store_summary(spark, folder):
    return scenes(spark, folder).agg(F.countDistinct("fingerprint").alias("scenes"), F.count_if(c("n_edges") > 10).alias("dense"), F.count("*").alias("sightings"))


@query("pending_topk", O.with_views("SELECT tick, n_edges FROM scene ORDER BY n_edges DESC, tick LIMIT 20", "cpa", **_SCENE))
def pending_topk(spark, folder):
    return scenes(spark, folder).select("tick", "n_edges").orderBy(F.desc("n_edges"), "tick").limit(20)


@query("prototype_round_robin", O.with_views("SELECT family, tick FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY min_tcpa, tick) AS turn FROM (SELECT *, tick % 6 AS family FROM scene QUALIFY row_number() OVER (PARTITION BY tick % 6, n_edges ORDER BY min_tcpa, tick) = 1)) ORDER BY turn, family LIMIT 20", "cpa", **_SCENE))
def prototype_round_robin(spark, folder):
    """Up to 20 scenes, one of each family in turn; of scenes alike only the most pressing one."""
    s = scenes(spark, folder).withColumn("family", c("tick") % 6)
    alike = Window.partitionBy("family", "n_edges").orderBy("min_tcpa", "tick")
    s = s.withColumn("n", F.row_number().over(alike)).where("n = 1")
    turn = F.row_number().over(Window.partitionBy("family").orderBy("min_tcpa", "tick"))
    return s.withColumn("turn", turn).orderBy("turn", "family").limit(20).select("family", "tick")


def ranks(spark, folder) -> DataFrame:
    """``tick, id, role``: a scene's aircraft by their close approaches and the earliest of them, then by id."""
    s = B.approach_degrees(A.tracks(spark, folder), 5.0).select("tick", "id", "degree", F.bround(c("min_tcpa") / 60).cast("long").alias("tb"))
    return s.select("tick", "id", F.row_number().over(Window.partitionBy("tick").orderBy(F.desc("degree"), "tb", "id")).alias("role"))


#: The severity of close approaches as contacts, whether or not they would be kept as such.
_SEVERE = {k: v.replace("FROM opairs", "FROM d").replace(" WHERE loss OR predicted OR temporal OR horiz_km <= 40", "") for k, v in CONTACTS.items()}


@query("role_order", O.with_views("""SELECT tick, id, row_number() OVER (PARTITION BY tick ORDER BY degree DESC, sb DESC, tb, ab DESC, kb DESC, hb, id) AS role FROM (SELECT tick, id, count(*) AS degree, round_even(round(max(severity), 9) / 0.25::DOUBLE, 0) AS sb,
    CAST(round_even(min(tcpa) / 60, 0) AS BIGINT) AS tb, round_even(alt / 0.3048::DOUBLE / 1000, 0) AS ab, round_even(gs * (3600.0::DOUBLE / 1852.0::DOUBLE) / 20, 0) AS kb, round_even(((trk % 360) + 360) % 360 / 30, 0) AS hb
    FROM (SELECT tick, id1 AS id, tcpa, severity, alt1 AS alt, gs1 AS gs, trk1 AS trk FROM contacts UNION ALL SELECT tick, id2, tcpa, severity, alt2, gs2, trk2 FROM contacts) GROUP BY tick, id, alt, gs, trk)""", "cpa",
    d="SELECT * FROM cpa WHERE cpa_nm < 5 AND abs(alt1 - alt2) / 0.3048::DOUBLE < 1000", **_SEVERE))
def role_order(spark, folder):
    """A stable rank of a scene's aircraft that does not depend on names until all else is equal: by how many close approaches they have, the worst
    of them, the earliest, height, speed and course, all but the first in buckets."""
    bucket = lambda x, width: F.bround(x / width)
    order = [
        F.desc("degree"), F.desc(bucket(F.round("severity", 9), 0.25)), bucket(c("min_tcpa"), 60), F.desc(bucket(c("alt") / B.FT_M, 1000)),
        F.desc(bucket(c("gs") * L.MPS_TO_KT, 20)), bucket(F.pmod("trk", F.lit(360.0)), 30), c("id"),
    ]
    s = C.approach_roles(A.tracks(spark, folder), 5.0)
    return s.select("tick", "id", F.row_number().over(Window.partitionBy("tick").orderBy(*order)).alias("role"))


@query("diverse_pool", views("SELECT event_id, candidate_id, place FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN in_kind = 1 THEN 0 ELSE 1 END, score DESC, candidate_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY score DESC, candidate_id) AS in_kind FROM sc)) WHERE place <= 6"))
def diverse_pool(spark, folder):
    """Six candidates of each state: the best of each kind first, then the best of the rest."""
    s = with_all(ordered(spark, folder))
    s = P.once(s.select("event_id", "all"), {"kinds": F.transform("all", lambda k: k["kind"])})
    turn = F.transform("all", lambda k, i: F.struct(F.when(F.array_position("kinds", k["kind"]) == i + 1, 0).otherwise(1).alias("again"), k["less"].alias("less"), k["candidate_id"].alias("candidate_id")))
    pool = s.select("event_id", F.posexplode(F.slice(F.sort_array(turn), 1, 6)).alias("at", "k"))
    return pool.select("event_id", "k.candidate_id", (c("at") + 1).alias("place"))


@query("perturb_scenarios")
def perturb_scenarios(spark, folder):
    """Every waypoint as a scenario start, in five copies moved by bounded noise from a hash, the same in any run."""
    k = c("s_suppkey")
    rows = table(spark, folder, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("copy"))
    noise = lambda seed: F.pmod(F.xxhash64(k, "copy", F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30) * 2 - 1
    return rows.select(k.alias("scenario"), "copy", (noise(1) * 5).alias("east_km"), (noise(2) * 5).alias("north_km"), (noise(3) * 10).alias("heading_deg"))


@query("significant_action_filter", O.with_views("SELECT event_id FROM (SELECT event_id, vs_mps, row_number() OVER (PARTITION BY trajectory_id ORDER BY t, event_id) AS n FROM track_path) WHERE n % 3 = 0 AND abs(vs_mps) >= 1", "track_path"))
def significant_action_filter(spark, folder):
    """Every third report of an aircraft, if it climbs or sinks enough."""
    n = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("t", "event_id"))
    return A.track_path(spark, folder).withColumn("n", n).where("n % 3 = 0 and abs(vs_mps) >= 1").select("event_id")


@query("join_tick_to_program", O.with_views("SELECT p.event_id, t.event_id AS tick_event FROM track_path p JOIN tracks t USING (trajectory_id, tick)", "tracks"))
def join_tick_to_program(spark, folder):
    t = A.tracks(spark, folder).select("trajectory_id", "tick", c("event_id").alias("tick_event"))
    return A.track_path(spark, folder).select("trajectory_id", "tick", "event_id").join(t, ["trajectory_id", "tick"]).select("event_id", "tick_event")


@query("tracked_topk", O.with_views("SELECT tick, id1, id2, row_number() OVER (PARTITION BY tick ORDER BY round(tcpa, 4), round(now_nm, 6), id1, id2) AS place FROM cpa WHERE cpa_nm < 5 QUALIFY place <= 3", "cpa"))
def tracked_topk(spark, folder):
    p = T.first_approaches(A.tracks(spark, folder), 5.0, 3)
    order = Window.partitionBy("tick").orderBy(F.round("tcpa", 4), F.round("now_nm", 6), "id1", "id2")
    return p.withColumn("place", F.row_number().over(order)).where("place <= 3").select("tick", "id1", "id2", "place")


@query("top_thresholds", views("SELECT threshold, positive_exact FROM met ORDER BY positive_exact DESC, threshold DESC LIMIT 20", d=f"SELECT event_id, {_TRUE} AS truth, candidate_id AS best, round(margin, 9) AS margin FROM bs", t="SELECT CAST(i AS DOUBLE) / 50 AS threshold FROM range(-50, 51) r(i)", met=_MET))
def top_thresholds(spark, folder):
    t = spark.range(-50, 51).select((c("id").cast("double") / 50).alias("threshold"))
    m = L.threshold_metrics(decided(spark, folder), t).select("threshold", F.round("positive_exact", 9).alias("positive_exact"))
    return m.orderBy(F.desc("positive_exact"), F.desc("threshold")).limit(20)
