"""Registered queries of resolution, complexity, routes, wind, episodes and the ranker."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import blocks as B
from skyledger.operators import pairs as P
from skyledger.operators import plan_blocks
from skyledger.operators import policy_queries as Q
from skyledger.operators import resolve as R
from skyledger.operators import resolve_blocks as V
from skyledger.operators import traffic_blocks as T
from skyledger.operators.sequence_queries import waypoints
from skyledger.plans import oracle as O
from skyledger.plans.components import connected_components
from skyledger.registry import query
from skyledger.session import stage_table
from skyledger.sources import adapters as A
from skyledger.sources.tables import table

c = F.col


#: Close pairs are within so much of each other now, and less than so much apart in height.
CLOSE_NM, CLOSE_M = 6.0, 700.0


def grouped(p: DataFrame) -> DataFrame:
    """Pairs with the component of their tick's graph that they belong to: the smallest id in it.

    Nodes are numbered over ticks and aircraft, so none of two ticks can fall together whatever the ids are.
    """
    p = stage_table(p, "group-pairs")
    each = p.select("tick", F.explode(F.array("id1", "id2")).alias("id")).distinct()
    names = stage_table(each.withColumn("node", F.monotonically_increasing_id()), "group-nodes")
    of = lambda n: names.select("tick", c("id").alias(f"id{n}"), c("node").alias(f"node{n}"))
    links = p.select("tick", "id1", "id2").join(of(1), ["tick", "id1"]).join(of(2), ["tick", "id2"])
    found = names.join(connected_components(links.select(c("node1").alias("a"), c("node2").alias("b")), "a", "b", crowded=True), "node")
    least = found.groupBy(c("component").alias("root")).agg(F.min("id").alias("component"))
    found = found.withColumnRenamed("component", "root").join(least, "root").select("tick", c("id").alias("id1"), "component")
    return p.join(found, ["tick", "id1"])


def members(g: DataFrame) -> DataFrame:
    """``tick, component, id`` of all aircraft of groups of pairs."""
    return g.select("tick", "component", F.explode(F.array("id1", "id2")).alias("id")).distinct()


def groups(states: DataFrame) -> DataFrame:
    """``tick, component, id`` of all aircraft of groups of close aircraft. Groups come from links that every two blocks leave, fewer than they
    have aircraft, so that a crowd's pairs are no rows."""
    return members(grouped(B.loss_links(states, math.nextafter(CLOSE_NM, math.inf), CLOSE_M / B.FT_M)))


def states_of_groups(spark, folder) -> DataFrame:
    """The states of all aircraft of groups of close aircraft, with the group and its mean latitude ``lat0``."""
    t = A.tracks(spark, folder)
    m = t.join(groups(t).withColumnRenamed("id", "trajectory_id"), ["tick", "trajectory_id"])
    m = stage_table(m, "group-states")
    return m.join(m.groupBy("tick", "component").agg(F.avg("lat").alias("lat0")), ["tick", "component"])


@query("action_compat_pairs")
def action_compat_pairs(spark, folder):
    return V.action_rows(A.tracks(spark, folder), CLOSE_NM, CLOSE_M)


@query("resolve_components")
def resolve_components(spark, folder):
    """One action per aircraft of each group of close aircraft; a group is of one tick, and a pair of it a number of its compatible actions."""
    t = A.tracks(spark, folder)
    rows = V.fit_rows(t, CLOSE_NM, CLOSE_M).join(groups(t).withColumnRenamed("id", "id1"), ["tick", "id1"])
    return rows.groupBy("tick", "component").applyInPandas(lambda x: R.solve(x), "tick long, component long, trajectory_id long, action int")


@query("level_assignment_greedy")
def level_assignment_greedy(spark, folder):
    t = A.tracks(spark, folder)
    g = V.close_rows(t, CLOSE_NM, CLOSE_M).join(groups(t).withColumnRenamed("id", "id1"), ["tick", "id1"])
    return g.groupBy("tick", "component").applyInPandas(lambda x: R.colour(x), "tick long, component long, trajectory_id long, level_m double")


_NEAR = "now_nm <= 6 AND abs(alt1 - alt2) < 700"
_PLANS = {
    "e": f"SELECT tick, id1 AS a, id2 AS b FROM cpa WHERE {_NEAR} UNION SELECT tick, id2, id1 FROM cpa WHERE {_NEAR}",
    "walk": "SELECT tick, a AS id, a AS seen FROM e UNION SELECT e.tick, e.b, w.seen FROM walk w JOIN e ON e.tick = w.tick AND e.a = w.id",
    "mem": "SELECT w.tick, w.id, min(w.seen) AS component FROM walk w GROUP BY ALL",
    "st": "SELECT m.tick, m.component, m.id, t.lat, t.lon, t.alt_m, t.gs_mps, t.trk_deg, avg(t.lat) OVER (PARTITION BY m.tick, m.component) AS lat0 FROM mem m JOIN tracks t ON t.tick = m.tick AND t.trajectory_id = m.id",
    "plans": "SELECT DISTINCT tick, component, id AS who, what FROM st, (VALUES ('TURN_LEFT'), ('TURN_RIGHT'), ('CLIMB'), ('DESCEND'), ('DECELERATE')) v(what) UNION ALL SELECT DISTINCT tick, component, -1, '' FROM st",
    "mv": """SELECT p.tick, p.component, p.who, p.what, s.id, s.lon * 111 * cos(radians(lat0)) AS x, s.lat * 111 AS y, s.alt_m / 0.3048::DOUBLE AS ft,
        greatest(0.0::DOUBLE, gs_mps - CASE WHEN s.id = p.who AND what = 'DECELERATE' THEN 20 * 0.514444::DOUBLE ELSE 0 END) / 1000 AS v,
        radians(trk_deg + CASE WHEN s.id <> p.who THEN 0 WHEN what = 'TURN_LEFT' THEN -30 WHEN what = 'TURN_RIGHT' THEN 30 ELSE 0 END) AS d,
        CASE WHEN s.id <> p.who THEN 0 WHEN what = 'CLIMB' THEN 1 WHEN what = 'DESCEND' THEN -1 ELSE 0 END AS k FROM plans p JOIN st s ON s.tick = p.tick AND s.component = p.component""",
    "run": """SELECT a.tick, a.component, a.who, a.what, sqrt(pow(b.x + b.v * sin(b.d) * t - a.x - a.v * sin(a.d) * t, 2) + pow(b.y + b.v * cos(b.d) * t - a.y - a.v * cos(a.d) * t, 2)) AS h,
        abs(b.ft + b.k * least(2000, 25 * t) - a.ft - a.k * least(2000, 25 * t)) AS z FROM mv a JOIN mv b ON a.tick = b.tick AND a.component = b.component AND a.who = b.who AND a.what = b.what AND a.id < b.id, (SELECT unnest(range(0, 121, 5)) AS t)""",
    "sc": "SELECT tick, component, who, what, round(1000.0::DOUBLE * count_if(h < 8 AND z < 1000) + greatest(0.0::DOUBLE, 8 - min(h)) + greatest(0.0::DOUBLE, 1000 - min(z)) / 1000, 6) AS score FROM run GROUP BY ALL",
}


@query("group_plan_templates", O.with_views("""SELECT tick, component, max(CASE WHEN who < 0 THEN score END) AS baseline, min(CASE WHEN who >= 0 THEN score END) AS score,
    arg_min(who, (score, who, what)) FILTER (who >= 0) AS who, arg_min(what, (score, who, what)) FILTER (who >= 0) AS what, min(CASE WHEN who >= 0 THEN score END) + 1e-6 < max(CASE WHEN who < 0 THEN score END) AS improves FROM sc GROUP BY ALL""", "cpa", **_PLANS).replace("WITH ", "WITH RECURSIVE ", 1))
def group_plan_templates(spark, folder):
    """For each group of close aircraft, who had best give way and how: the fewest losses and the most room over all its pairs."""
    s = plan_blocks.group_plans(states_of_groups(spark, folder))
    best = F.min(F.when(c("who") >= 0, F.struct("score", "who", "what"))).alias("best")
    g = s.groupBy("tick", "component").agg(best, F.min(F.when(c("who") < 0, c("score"))).alias("baseline"))
    return g.select("tick", "component", "baseline", "best.score", "best.who", "best.what", (c("best.score") + 1e-6 < c("baseline")).alias("improves"))


#: An aircraft at a fixed gate that is to be let in.
ENTRANT = {"lat1": 30.2, "lon1": 103.2, "alt1": 12000.0, "gs1": 220.0, "trk1": 90.0, "vs1": 0.0}
ENTRY_NM, ENTRY_FT = 20.0, 5000.0
_ENTRY = {
    "e0": f"""SELECT tick, trajectory_id AS id, (lon - 103.2) * 60 * cos(radians(30.92095)) AS rx, (lat - 30.2) * 60 AS ry, gs_mps / 1852 * sin(radians(trk_deg)) - 220.0::DOUBLE / 1852 * sin(radians(90)) AS vx,
        gs_mps / 1852 * cos(radians(trk_deg)) - 220.0::DOUBLE / 1852 * cos(radians(90)) AS vy, abs(alt_m - 12000) / 0.3048::DOUBLE AS ft FROM tracks""",
    "e1": "SELECT *, greatest(0.0::DOUBLE, least(300.0::DOUBLE, -(rx * vx + ry * vy) / greatest(vx * vx + vy * vy, 1e-12))) AS tc FROM e0",
    "e2": "SELECT tick, id, CASE WHEN ft >= 5000 THEN '' WHEN sqrt(rx * rx + ry * ry) < 20 THEN 'entry gate' WHEN sqrt(pow(rx + vx * tc, 2) + pow(ry + vy * tc, 2)) < 20 THEN 'predicted' ELSE '' END AS why FROM e1",
}


@query("entry_gate_check", O.with_views("SELECT tick, count(*) AS aircraft, coalesce(arg_min(why, id) FILTER (why <> ''), '') AS reason, min(id) FILTER (why <> '') AS against FROM e2 GROUP BY tick", "tracks", **_ENTRY))
def entry_gate_check(spark, folder):
    """Whether an aircraft could enter at a fixed gate in each tick; if not, why, and against which aircraft: the first that is
    near the gate now, or that comes near it by its closest approach."""
    fixed = {k: F.lit(v) for k, v in ENTRANT.items()}
    t = P.with_cpa(P._side(A.tracks(spark, folder), 2).withColumns(fixed))
    near, later = c("now_nm") < ENTRY_NM, c("cpa_nm") < ENTRY_NM
    why = F.when(P.vertical_ft() < ENTRY_FT, F.when(near, "entry gate").when(later, "predicted"))
    first = F.min(F.when(why.isNotNull(), F.struct(c("id2").alias("id"), why.alias("why")))).alias("first")
    found = t.groupBy("tick").agg(F.count("*").alias("aircraft"), first)
    return found.select("tick", "aircraft", F.coalesce("first.why", F.lit("")).alias("reason"), c("first.id").alias("against"))


_REL = O.pmod(f"{O.bearing('lat1', 'lon1', 'lat2', 'lon2')} - trk1")
_HDG = O.pmod("trk2 - trk1")


@query("encounter_rule_class", O.with_views(f"SELECT rule, count(*) AS n FROM (SELECT CASE WHEN h BETWEEN 160 AND 200 THEN 'head_on' WHEN h <= 20 OR h >= 340 THEN 'overtake' WHEN b < 180 THEN 'crossing_right' ELSE 'crossing_left' END AS rule FROM (SELECT round({_HDG}, 9) AS h, round({_REL}, 9) AS b FROM opairs)) GROUP BY 1", "opairs"))
def encounter_rule_class(spark, folder):
    """Which rule of the air holds for either side of each pair, by their courses and by the side on which the other is."""
    return T.encounter_rules(A.tracks(spark, folder))


@query("sector_convergence", O.with_views("SELECT tick, round(sum(sqrt(2.0 + pow(cpa_nm, 2))), 5) AS convergence, count(*) AS n FROM cpa WHERE cpa_nm < 20 AND tcpa > 0 GROUP BY tick", "cpa"))
def sector_convergence(spark, folder):
    """The sum over converging pairs of the root of 2 and the squared miss distance: the first term is a constant, as in
    the metric that this is to agree with; ``2 / t`` would be the inverse form."""
    return T.convergence(A.tracks(spark, folder), 20.0).select("tick", F.round("convergence", 5).alias("convergence"), "n")


_BAND = "degrees(asin(least(1.0::DOUBLE, 5.0::DOUBLE / greatest(now_nm, 5.0::DOUBLE))))"
_TOWARDS = O.bearing("lat1", "lon1", "lat2", "lon2")
_MID = f"round({O.wrap180(f'{_TOWARDS} - trk1')}, 6)"


@query("heading_band_complexity", O.with_views(
    "SELECT tick, id1, round(sum(b - a) / 180, 4) AS share FROM (SELECT tick, id1, island, min(a) AS a, max(b) AS b FROM g GROUP BY ALL) GROUP BY ALL", "opairs",
    w="SELECT *, sqrt(pow((lon2 - lon1) * 60 * cos(radians(30.92095)), 2) + pow((lat2 - lat1) * 60, 2)) AS now_nm FROM opairs WHERE abs(alt1 - alt2) < 600",
    i=f"SELECT tick, id1, id2, greatest(-90.0::DOUBLE, mid - half) AS a, least(90.0::DOUBLE, mid + half) AS b FROM (SELECT *, round({_BAND}, 6) AS half, {_MID} AS mid FROM w WHERE now_nm < 40) WHERE mid - half < 90 AND mid + half > -90",
    m="SELECT *, max(b) OVER (PARTITION BY tick, id1 ORDER BY a, b, id2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i",
    g="SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tick, id1 ORDER BY a, b, id2 ROWS UNBOUNDED PRECEDING) AS island FROM m"))
def heading_band_complexity(spark, folder):
    """The share of headings within 90 degrees that lead towards an aircraft near in height: a band per neighbour, merged."""
    i = T.bands(A.tracks(spark, folder), 40.0, 600.0, 5.0)
    order = Window.partitionBy("tick", "id1").orderBy("a", "b")
    i = i.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("island", F.sum(F.when(c("reach").isNull() | (c("a") > c("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = i.groupBy("tick", "id1", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("tick", "id1").agg(F.round(F.sum(c("b") - c("a")) / 180, 4).alias("share"))


# -- routes, wind and names -----------------------------------------------------------------------------------------------

_ROUTE = "SELECT o_orderkey AS plan, l_linenumber AS n, 'W' || l_partkey AS fix, l_linestatus = 'O' AS passed, l_quantity AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("route_context", """SELECT plan, coalesce(min(CASE WHEN NOT passed THEN n END), max(n)) AS next_n, round(count_if(passed) / count(*), 9) AS progress, count(*) AS points FROM r GROUP BY plan""".join(["WITH r AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_linestatus = 'O' AS passed FROM lineitem) ", ""]))
def route_context(spark, folder):
    """From a plan's points as an array: the first that is not passed (or the last), and the share that is passed."""
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (c("l_linestatus") == "O").alias("passed"))
    plans = table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("plan")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    ahead = F.array_min(F.filter(F.transform("p", lambda x, i: F.when(~x["passed"], i + 1)), lambda i: i.isNotNull()))
    passed = F.size(F.filter("p", lambda x: x["passed"]))
    return plans.select("plan", F.coalesce(ahead, F.size("p")).cast("long").alias("next_n"), F.round(passed / F.size("p"), 9).alias("progress"), F.size("p").cast("long").alias("points"))


@query("airway_connections", "SELECT DISTINCT a, b FROM (SELECT l_partkey % 200 AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_partkey % 200 FROM lineitem) WHERE a <> b")
def airway_connections(spark, folder):
    """Neighbours of waypoints over legs in either direction, each once."""
    legs = table(spark, folder, "lineitem").select((c("l_partkey") % 200).alias("a"), c("l_suppkey").alias("b")).distinct()
    return legs.unionByName(legs.select(c("b").alias("a"), c("a").alias("b"))).where("a <> b").distinct()


@query("airway_chains")
def airway_chains(spark, folder):
    """Legs of each airway put in order as chains of waypoints; an airway is a supplier's nation here."""
    legs = waypoints(spark, folder).select((c("wpt") % 12).alias("airway"), c("wpt").alias("a"), (c("wpt") * 7 % 90).alias("b")).where("a <> b")
    return legs.groupBy("airway").applyInPandas(lambda x: chains(x), "airway long, chain int, place int, wpt long")


def chains(legs):
    """The legs of one airway as paths that use each leg once: from an end or, in a ring, from the least waypoint."""
    import pandas as pd

    near: dict[int, list[int]] = {}
    for a, b in sorted({(min(a, b), max(a, b)) for a, b in zip(legs.a, legs.b)}):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out, number = [], 0
    while any(near.values()):
        at = min((k for k in near if near[k]), key=lambda k: (len(near[k]) % 2 == 0, k))
        out.append((legs.airway.iloc[0], number, 0, at))
        place = 1
        while near[at]:
            nxt = near[at].pop(0)
            near[nxt].remove(at)
            out.append((legs.airway.iloc[0], number, place, nxt))
            at, place = nxt, place + 1
        number += 1
    return pd.DataFrame(out, columns=["airway", "chain", "place", "wpt"])


@query("wind_interpolate", O.with_views("""SELECT event_id, round(sum(w * vn) / sum(w), 6) AS vn, round(sum(w * ve) / sum(w), 6) AS ve FROM (SELECT t.event_id, p.vn, p.ve, 1 / greatest(pow(p.lat - t.lat, 2) + pow((p.lon - t.lon) * cos(radians(t.lat)), 2), 1e-9) AS w FROM tracks t CROSS JOIN p) GROUP BY 1""", "tracks",
    p="SELECT 30 + CAST(r_regionkey AS DOUBLE) / 5 AS lat, 103 + CAST(r_regionkey AS DOUBLE) * 0.3 AS lon, 10.0::DOUBLE + r_regionkey AS vn, 5.0::DOUBLE - r_regionkey AS ve FROM region"))
def wind_interpolate(spark, folder):
    """Wind at each state by inverse squared distance from the points of a wind field.

    The field (a row per region) is gathered into one array, whose size is checked, and folded per state.
    """
    k = c("r_regionkey").cast("double")
    points = table(spark, folder, "region").select((30 + k / 5).alias("lat"), (103 + k * 0.3).alias("lon"), (10 + k).alias("vn"), (5 - k).alias("ve"))
    if points.count() > 100_000:
        raise ValueError("a wind field of so many points needs a join by cells")
    field = points.agg(F.collect_list(F.struct("lat", "lon", "vn", "ve")).alias("field"))
    t = A.tracks(spark, folder).crossJoin(F.broadcast(field))
    w = lambda p: 1 / F.greatest(F.pow(p["lat"] - c("lat"), 2) + F.pow((p["lon"] - c("lon")) * F.cos(F.radians("lat")), 2), F.lit(1e-9))
    total = lambda of: F.aggregate(F.transform("field", of), F.lit(0.0), lambda a, x: a + x)
    return t.select("event_id", F.round(total(lambda p: w(p) * p["vn"]) / total(w), 6).alias("vn"), F.round(total(lambda p: w(p) * p["ve"]) / total(w), 6).alias("ve"))


@query("resolve_position_text", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'latlon' WHEN c_custkey % 4 = 1 AND s_suppkey IS NOT NULL THEN 'navaid' WHEN n_nationkey IS NOT NULL AND c_custkey % 4 = 2 THEN 'airport' ELSE 'unknown' END AS kind
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey""")
def resolve_position_text(spark, folder):
    """What a position text is: a coordinate pair, an airport or a navaid of that name, in this order, or unknown."""
    k = c("c_custkey")
    t = table(spark, folder, "customer").select(k, F.when(k % 4 == 0, "30.5,103.2").when(k % 4 == 1, F.concat(F.lit("S"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("N"), k.cast("string"))).otherwise("?").alias("text"))
    aids = table(spark, folder, "supplier").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("text"), F.lit(True).alias("aid"))
    ports = table(spark, folder, "nation").select(F.concat(F.lit("N"), c("n_nationkey").cast("string")).alias("text"), F.lit(True).alias("port"))
    found = t.join(aids, "text", "left").join(ports, "text", "left")
    kind = F.when(c("text").rlike(r"^-?[0-9.]+,-?[0-9.]+$"), "latlon").when(c("port"), "airport").when(c("aid"), "navaid").otherwise("unknown")
    return found.select("c_custkey", kind.alias("kind"))


@query("type_default_join", "SELECT p_partkey, coalesce(s_acctbal, (SELECT avg(s_acctbal) FROM supplier)) AS coefficient FROM (SELECT p_partkey, p_size + 60 AS k FROM part) LEFT JOIN supplier ON s_suppkey = k".replace("coalesce(s_acctbal, (SELECT avg(s_acctbal) FROM supplier))", "round(coalesce(s_acctbal, (SELECT avg(s_acctbal) FROM supplier)), 6)"))
def type_default_join(spark, folder):
    """A coefficient by type, and the mean of all types where the type has none."""
    s = table(spark, folder, "supplier")
    p = table(spark, folder, "part").select("p_partkey", (c("p_size") + 60).cast("long").alias("s_suppkey"))
    mean = s.agg(F.avg("s_acctbal").alias("mean"))
    return p.join(s.select("s_suppkey", "s_acctbal"), "s_suppkey", "left").crossJoin(F.broadcast(mean)).select("p_partkey", F.round(F.coalesce("s_acctbal", "mean"), 6).alias("coefficient"))


@query("scene_lookup_fallback", O.with_views("SELECT s.tick, CASE WHEN e.fingerprint IS NOT NULL THEN 'exact' WHEN d.n_edges IS NOT NULL THEN 'canonical' ELSE 'miss' END AS source FROM scene s LEFT JOIN (SELECT DISTINCT fingerprint FROM scene WHERE tick % 2 = 0) e ON s.fingerprint = e.fingerprint LEFT JOIN (SELECT DISTINCT n_edges FROM scene WHERE tick % 2 = 0) d ON s.n_edges = d.n_edges", "cpa", **Q._SCENE))
def scene_lookup_fallback(spark, folder):
    """Every scene looked up in a store of the scenes of even ticks: by fingerprint, then by a coarser key."""
    s = Q.scenes(spark, folder)
    store = s.where("tick % 2 = 0")
    exact, coarse = store.select("fingerprint", F.lit(True).alias("e")).distinct(), store.select("n_edges", F.lit(True).alias("d")).distinct()
    found = s.select("tick", "fingerprint", "n_edges").join(exact, "fingerprint", "left").join(coarse, "n_edges", "left")
    return found.select("tick", F.when(c("e"), "exact").when(c("d"), "canonical").otherwise("miss").alias("source"))


@query("fallback_safe_choice", Q.views("SELECT event_id, arg_min(candidate_id, n) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, candidate_id) AS n FROM sc WHERE candidate_id <> 'HOLD') WHERE n <= 4 AND abs(delta) < 1500 GROUP BY 1"))
def fallback_safe_choice(spark, folder):
    """The first safe one among a state's first four candidates by score (here safe: a change of less than 1500)."""
    safe = F.filter(F.slice("ranked", 1, 4), lambda k: F.abs(k["delta"]) < 1500)
    found = Q.ordered(spark, folder).select("event_id", F.get(safe, F.lit(0))["candidate_id"].alias("chosen"))
    return found.where("chosen is not null")


@query("parameter_decode", O.with_views("SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN 1 / 6.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 5 / 6.0::DOUBLE END * 30 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END, 9) AS turn_deg, greatest(CASE event_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 ELSE 30.0 END, 15.0)::DOUBLE AS hold_s FROM track_path", "track_path"))
def parameter_decode(spark, folder):
    """Levels and signs of an action as signed magnitudes and holding times."""
    i = c("event_id")
    share = F.when(i % 3 == 0, 1 / 6).when(i % 3 == 1, 0.5).otherwise(5 / 6)
    hold = F.when(i % 3 == 0, 10.0).when(i % 3 == 1, 20.0).otherwise(30.0)
    return A.track_path(spark, folder).select("event_id", F.round(share * 30 * F.when(i % 2 == 0, 1).otherwise(-1), 9).alias("turn_deg"), F.greatest(hold, F.lit(15.0)).alias("hold_s"))


@query("episode_metrics", O.with_views("SELECT episode, count_if(hit AND NOT coalesce(was, false)) AS detected, count_if(NOT hit AND coalesce(was, false)) AS resolved, min(horizontal_km) AS least_km FROM (SELECT *, horizontal_km < 7 AS hit, lag(horizontal_km < 7) OVER (PARTITION BY episode ORDER BY sim_time_s, event_id) AS was FROM run_events) GROUP BY 1", "run_events"))
def episode_metrics(spark, folder):
    """Onsets and resolutions of a flag along each episode, and its minimum."""
    hit = c("horizontal_km") < 7
    e = A.run_events(spark, folder).withColumns({"hit": hit, "was": F.lag(hit).over(Window.partitionBy("episode").orderBy("sim_time_s", "event_id"))})
    return e.groupBy("episode").agg(F.count_if(c("hit") & ~F.coalesce("was", F.lit(False))).alias("detected"), F.count_if(~c("hit") & c("was")).alias("resolved"), F.min("horizontal_km").alias("least_km"))


def training_alerts(episodes: DataFrame, least_entropy: float = 0.1, least_available: int = 20, most_loss: float = 10.0) -> DataFrame:
    """Episodes with three flags, and the mean and deviation of their parameter over its samples.

    ``collapsed``: an update left the choice of actions with an entropy below the least, one that is not known counting as 0;
    ``starved``: headings were open often enough and none was taken; ``diverging``: an update's loss is above the most, one
    that is not known counting as 0. Sums are divided by the number of samples, or by one without any.
    """
    updated, samples = F.coalesce("update_performed", F.lit(False)), F.greatest("samples", F.lit(1))
    return episodes.withColumns({
        "collapsed": updated & (F.coalesce("discrete_entropy", F.lit(0.0)) < least_entropy), "starved": (c("available_headings") >= least_available) & (c("headings") == 0),
        "diverging": updated & (F.coalesce("critic_loss", F.lit(0.0)) > most_loss), "parameter_mean": c("mean_sum") / samples, "parameter_std": c("std_sum") / samples,
    })


@query("episode_alerts", O.with_views("""SELECT row_id, safe_success = 1 AND (row_id % 7 = 0 OR CAST(row_id % 10 AS DOUBLE) / 10 < 0.2::DOUBLE) AS collapsed, command_count * 3 >= 20 AND row_id % 3 = 0 AS starved, safe_success = 1 AND episode_return > 10 AS diverging,
    round(episode_return / greatest(command_count, 1), 6) AS parameter_mean, round(separation_horizontal_km / greatest(command_count, 1), 6) AS parameter_std FROM diagnostics""", "diagnostics"))
def episode_alerts(spark, folder):
    """Flags of every episode of the diagnostics; every seventh has no entropy."""
    k = c("row_id")
    episodes = A.diagnostics(spark, folder).select(
        k, (c("safe_success") == 1).alias("update_performed"), F.when(k % 7 != 0, (k % 10).cast("double") / 10).alias("discrete_entropy"), (c("command_count") * 3).alias("available_headings"),
        (k % 3).alias("headings"), c("episode_return").alias("critic_loss"), c("episode_return").alias("mean_sum"), c("separation_horizontal_km").alias("std_sum"), c("command_count").alias("samples"),
    )
    found = training_alerts(episodes, least_entropy=0.2)
    return found.select("row_id", "collapsed", "starved", "diverging", F.round("parameter_mean", 6).alias("parameter_mean"), F.round("parameter_std", 6).alias("parameter_std"))


@query("sample_tags", O.with_views("SELECT tick, CASE WHEN n_edges > 1 THEN 'multi_pair' ELSE 'single_pair' END || CASE WHEN min_tcpa < 30 THEN ',urgent' ELSE '' END || CASE WHEN n_edges > 10 THEN ',dense' ELSE '' END AS tags FROM scene", "cpa", **Q._SCENE))
def sample_tags(spark, folder):
    """Tags of each scene as an array without what does not hold, written as text."""
    tags = F.array_compact(F.array(F.when(c("n_edges") > 1, "multi_pair").otherwise("single_pair"), F.when(c("min_tcpa") < 30, "urgent"), F.when(c("n_edges") > 10, "dense")))
    return Q.scenes(spark, folder).select("tick", F.array_join(tags, ",").alias("tags"))


@query("training_samples")
def training_samples(spark, folder):
    """A nested sample per tick: its aircraft and its conflict edges."""
    states = A.tracks(spark, folder)
    t = states.groupBy("tick").agg(F.sort_array(F.collect_list(F.struct("trajectory_id", "lat", "lon", "alt_m"))).alias("aircraft"))
    e = B.close_approaches(states, 5.0, 1000.0).select("tick", F.struct("id1", "id2", F.round("tcpa", 3).alias("tcpa")).alias("edge"))
    e = e.groupBy("tick").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return t.join(e, "tick", "left").select("tick", F.size("aircraft").alias("n_aircraft"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"), F.to_json(F.struct("aircraft", "edges")).alias("sample"))


# -- the ranker -----------------------------------------------------------------------------------------------------------


def ranker(features: list[str], categories: list[str]) -> Pipeline:
    """Categories as indexes and one-hot vectors, numbers beside them, and boosted trees with row weights."""
    index = StringIndexer(inputCols=categories, outputCols=[f"{x}_i" for x in categories], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{x}_i" for x in categories], outputCols=[f"{x}_h" for x in categories], handleInvalid="keep")
    together = VectorAssembler(inputCols=[*features, *[f"{x}_h" for x in categories]], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[index, hot, together, GBTClassifier(labelCol="label", weightCol="weight", maxIter=8, maxDepth=4, seed=7)])


def alike(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different values of ``columns``, each with its number of rows ``n``; what a model learns from the rows, or says of them, it learns
    from these by their weights, or says once. Candidates have few different values, however many states there are."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def fitted(rows: DataFrame, features: list[str], categories: list[str]) -> PipelineModel:
    """The ranker fitted on all rows: equal ones count as one with the sum of their weights, so that trees are grown from the same sums."""
    few = alike(rows, [*features, *categories, "label", "weight"]).withColumn("weight", c("weight") * c("n"))
    return ranker(features, categories).fit(stage_table(few, "ranker-rows"))


def positive_score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``: the model's probability of a choice. A map over rows, whatever their number."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def labelled_candidates(spark, folder) -> DataFrame:
    """Candidates with a label that follows a rule, and a weight."""
    e = Q.scored(spark, folder).select("event_id", "candidate_id", "kind", "direction", "phase", "delta", "alt_m", "gs_mps", "vs_mps")
    wanted = ((c("direction") == "climb") & (c("vs_mps") > 0)) | ((c("direction") == "hold") & (c("vs_mps") == 0))
    return e.withColumns({"label": wanted.cast("double"), "weight": F.when(wanted, 3.0).otherwise(1.0)})


FEATURES, CATEGORIES = ["delta", "alt_m", "gs_mps", "vs_mps"], ["kind", "direction", "phase"]


@query("ranker_score")
def ranker_score(spark, folder):
    """Every candidate's score by a ranker that is fitted on the candidates of even states."""
    rows = labelled_candidates(spark, folder)
    model = fitted(rows.where("event_id % 2 = 0"), FEATURES, CATEGORIES)
    return positive_score(model, rows).select("event_id", "candidate_id", "label", F.round("score", 9).alias("score"))


@query("schema_guard", Q.views("SELECT v.name, v.name <> 'true_candidate_id' AS present, CASE v.name WHEN 'event_id' THEN count(event_id) WHEN 'candidate_id' THEN count(candidate_id) WHEN 'score' THEN count(score) ELSE 0 END AS filled FROM sc, (VALUES ('event_id'), ('candidate_id'), ('score'), ('true_candidate_id')) v(name) GROUP BY v.name"))
def schema_guard(spark, folder):
    """Which required columns the candidates have, and how many rows have a value in each."""
    return column_report(Q.scored(spark, folder), ["event_id", "candidate_id", "score", "true_candidate_id"])


def column_report(rows: DataFrame, required: list[str]) -> DataFrame:
    """``name, present, filled`` of required columns."""
    counted = rows.agg(*[F.count(x).alias(x) if x in rows.columns else F.lit(0).cast("long").alias(x) for x in required])
    each = [F.struct(F.lit(x).alias("name"), F.lit(x in rows.columns).alias("present"), c(x).alias("filled")) for x in required]
    return counted.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, or an error that names the columns they lack."""
    lacking = sorted(set(columns) - set(rows.columns))
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return rows


@query("ranker_pipeline")
def ranker_pipeline(spark, folder):
    """The ranker fitted on candidates whose choice follows a rule, and its mean scores of all of them."""
    rows = require(labelled_candidates(spark, folder), [*FEATURES, *CATEGORIES, "label", "weight"])
    few = stage_table(alike(rows, [*FEATURES, *CATEGORIES, "label", "weight"]), "ranker-alike")
    scored = positive_score(fitted(few.withColumn("weight", c("weight") * c("n")), FEATURES, CATEGORIES), few)
    mean = F.sum(c("score") * c("n")) / F.sum("n")
    return scored.groupBy("direction", "label").agg(F.sum("n").alias("n"), F.round(mean, 6).alias("mean_score"))
