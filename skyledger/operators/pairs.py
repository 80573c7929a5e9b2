"""Pairs of aircraft in a tick: closest approach, conflicts, risk, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators.blocks import closest_of_all
from skyledger.operators.cells import SHORT, STATE, near_pairs

HORIZON_S = 300.0
LOSS_NM, LOSS_FT, LOSS_SLACK_FT = 5.0, 1000.0, 1.0
GATE_NM = 20.0


def _side(states: DataFrame, n: int) -> DataFrame:
    return states.select("tick", F.col("trajectory_id").alias(f"id{n}"), *[F.col(c).alias(f"{SHORT[c]}{n}") for c in STATE])


def once(p: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``p`` with further columns that are worked out once.

    Conditions on them would else be moved before the step that makes them and their formulas copied as often as
    they are named, which makes generated code too large to compile. A generator of one row holds them back.
    """
    made = F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return p.select(*[F.col(n) for n in p.columns if n not in columns], made)


def flown_nm(within_s: float) -> Column:
    """How far an aircraft flies at its speed over ground."""
    return F.abs("gs_mps") / geo.NM_M * within_s


def pairs(states: DataFrame, ordered: bool = False) -> DataFrame:
    """All pairs of one tick, each once, or in both orders: for ticks of a bounded number of aircraft, such as one sector's.

    Ticks are the join key, so pairs never cross ticks. Where a result has a reach, ``pairs_within`` is to be used.
    """
    same = F.col("id1") != F.col("id2") if ordered else F.col("id1") < F.col("id2")
    return _side(states, 1).join(_side(states, 2), "tick").where(same)


def pair_totals(states: DataFrame) -> DataFrame:
    """``tick, n_pairs, ids1, ids2``: how many pairs ``pairs`` makes of each tick, and the sums of their ids, without making them.

    An id is the first of as many pairs as there are rows of larger ids in its tick, and the second of as many as there are of smaller ones.
    """
    ids = states.where("tick is not null and trajectory_id is not null").groupBy("tick", F.col("trajectory_id").alias("id")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("tick").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    total = ids.groupBy("tick").agg(F.sum("n").alias("all"))
    ids = ids.withColumn("upto", F.sum("n").over(order)).join(total, "tick")
    after, before = F.col("n") * (F.col("all") - F.col("upto")), F.col("n") * (F.col("upto") - F.col("n"))
    out = ids.groupBy("tick").agg(F.sum(after).alias("n_pairs"), F.sum(F.col("id") * after).alias("ids1"), F.sum(F.col("id") * before).alias("ids2"))
    return out.where("n_pairs > 0")


def others(states: DataFrame) -> DataFrame:
    """``tick, id1, n_others, first_id, last_id``: how many ordered pairs begin with each id of a tick, and the least and the greatest of
    the other ids, without making pairs: they are the ends of the tick, or those next to them."""
    ids = states.where("tick is not null and trajectory_id is not null").groupBy("tick", F.col("trajectory_id").alias("id1")).agg(F.count("*").alias("n"))
    ends = ids.groupBy("tick").agg(F.sum("n").alias("all"), F.min("id1").alias("low"), F.max("id1").alias("high"))
    inner = ids.join(ends, "tick").groupBy("tick", "all", "low", "high").agg(
        F.min(F.when(F.col("id1") > F.col("low"), F.col("id1"))).alias("second"), F.max(F.when(F.col("id1") < F.col("high"), F.col("id1"))).alias("last_but_one"))
    each = ids.join(inner, "tick").where("all > n")
    return each.select(
        "tick", "id1", (F.col("n") * (F.col("all") - F.col("n"))).alias("n_others"),
        F.when(F.col("id1") == F.col("low"), F.col("second")).otherwise(F.col("low")).alias("first_id"),
        F.when(F.col("id1") == F.col("high"), F.col("last_but_one")).otherwise(F.col("high")).alias("last_id"),
    )


def pairs_within(states: DataFrame, radius_nm: float, ordered: bool = False) -> DataFrame:
    """Pairs of a tick that are within a radius, each once or in both orders.

    The distance is that on the sector's plane, over the date line too. Cells are a join key beside the tick, so that
    work follows the number of near pairs and a crowded tick is spread over tasks.
    """
    return with_relative(near_pairs(states, radius_nm, ordered=ordered, sphere=False)).where(F.col("now_nm") <= radius_nm)


def over_date_line(degrees: Column) -> Column:
    """A difference of longitudes, the shorter way; those under 180 degrees stay exactly as they are."""
    return degrees - 360.0 * F.rint(degrees / 360.0)


def with_relative(p: DataFrame) -> DataFrame:
    """Relative position and velocity on the sector's plane, the shorter way round the earth, and the distance now."""
    rx, ry = geo.east_north_nm(F.col("lat2") - F.col("lat1"), over_date_line(F.col("lon2") - F.col("lon1")))
    vx1, vy1 = geo.velocity_nm_s(F.col("trk1"), F.col("gs1"))
    vx2, vy2 = geo.velocity_nm_s(F.col("trk2"), F.col("gs2"))
    out = once(p, {"rx": rx, "ry": ry, "vx": vx2 - vx1, "vy": vy2 - vy1})
    return out.withColumn("now_nm", F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")))


def with_cpa(p: DataFrame, horizon_s: float = HORIZON_S) -> DataFrame:
    """Time and distance of closest approach, the time held to [0, horizon]; 0 if the pair does not move apart or on."""
    r = p if "now_nm" in p.columns else with_relative(p)
    vv = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    free = -(F.col("rx") * F.col("vx") + F.col("ry") * F.col("vy")) / vv
    r = once(r, {"tcpa": F.when(vv <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(horizon_s), free)))})
    dx, dy = F.col("rx") + F.col("vx") * F.col("tcpa"), F.col("ry") + F.col("vy") * F.col("tcpa")
    return r.withColumn("cpa_nm", F.sqrt(dx * dx + dy * dy))


def approaches(states: DataFrame, gate_nm: float, horizon_s: float = HORIZON_S) -> DataFrame:
    """Pairs whose closest approach within the horizon is under the gate; found by cells as wide as those of a speed can reach."""
    found = with_cpa(near_pairs(states, gate_nm, flown_nm(horizon_s), sphere=False), horizon_s)
    return found.where(F.col("cpa_nm") < gate_nm)


def vertical_ft() -> Column:
    return F.abs(F.col("alt1") - F.col("alt2")) / 0.3048


def geometry(gate_nm: float = GATE_NM) -> Column:
    """How two courses meet, by their difference rounded to whole degrees."""
    d = F.bround(F.abs(geo.wrap180(F.col("trk1") - F.col("trk2"))))
    near = F.when(F.col("now_nm") < gate_nm, "overtaking").otherwise("parallel")
    return F.when(d >= 150, "head_on").when(d <= 20, near).when(d.between(55, 125), "crossing").otherwise("converging")


def risk(tcpa_min: Column, cpa_nm: Column, now_nm: Column) -> Column:
    critical = (now_nm < LOSS_NM) | (cpa_nm < 1.0) | (tcpa_min <= 2.0)
    high, medium = (cpa_nm < 3.0) | (tcpa_min <= 5.0), (cpa_nm < LOSS_NM) | (tcpa_min <= 8.0)
    return F.when(critical, "critical").when(high, "high").when(medium, "medium").otherwise("low")


def loss_events(p: DataFrame) -> DataFrame:
    """Pairs under both minima now; ``p`` has the distance now."""
    return p.withColumn("vsep_ft", vertical_ft()).where((F.col("now_nm") < LOSS_NM) & (F.col("vsep_ft") < LOSS_FT - LOSS_SLACK_FT))


def predicted_conflicts(p: DataFrame) -> DataFrame:
    """Pairs that come within the gate and are vertically close; ``p`` has the closest approach."""
    return p.withColumn("vsep_ft", vertical_ft()).where((F.col("cpa_nm") < GATE_NM) & (F.col("vsep_ft") < LOSS_FT))


def directed_conflicts(states: DataFrame, zone_m: float = 9260.0, height_m: float = 304.8, lookahead_s: float = 300.0, radius: str = "mean") -> DataFrame:
    """Directed state-based conflicts: entry and exit of a disc and of a slab, cut with each other and the look-ahead.

    Distances take the earth's radius at the pair's mean latitude; ``radius='sum'`` takes it at the sum, for results
    that are to match systems which do so.
    """
    p = near_pairs(states, zone_m / geo.NM_M, flown_nm(lookahead_s), ordered=True)
    a = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    dist = geo.distance_nm(*a) * geo.NM_M
    if radius == "sum":
        dist = dist / geo.earth_radius(0.5 * (a[0] + a[2])) * geo.earth_radius(a[0] + a[2])
    p = once(p, {"qdr": geo.bearing(*a), "dist_m": dist})
    u = lambda n: F.col(f"gs{n}") * F.sin(F.radians(f"trk{n}"))
    v = lambda n: F.col(f"gs{n}") * F.cos(F.radians(f"trk{n}"))
    p = once(p, {"dx": F.col("dist_m") * F.sin(F.radians("qdr")), "dy": F.col("dist_m") * F.cos(F.radians("qdr")), "du": u(2) - u(1), "dv": v(2) - v(1)})
    p = p.withColumn("dv2", F.greatest(F.col("du") ** 2 + F.col("dv") ** 2, F.lit(1e-6)))
    p = once(p, {"tcpa": -(F.col("du") * F.col("dx") + F.col("dv") * F.col("dy")) / F.col("dv2")})
    p = p.withColumn("dcpa2", F.abs(F.col("dist_m") ** 2 - F.col("tcpa") ** 2 * F.col("dv2")))
    half = F.sqrt(F.greatest(F.lit(0.0), zone_m**2 - F.col("dcpa2"))) / F.sqrt(F.col("dv2"))
    inside = F.col("dcpa2") < zone_m**2
    p = once(p.where(inside), {"in_h": F.when(inside, F.col("tcpa") - half).otherwise(1e8), "out_h": F.when(inside, F.col("tcpa") + half).otherwise(-1e8)})
    dalt, dvs = F.col("alt2") - F.col("alt1"), F.col("vs2") - F.col("vs1")
    dvs = F.when(F.abs(dvs) < 1e-6, 1e-6).otherwise(dvs)
    high, low = (dalt + height_m) / -dvs, (dalt - height_m) / -dvs
    p = once(p, {"tinconf": F.greatest("in_h", F.least(high, low)), "toutconf": F.least("out_h", F.greatest(high, low))})
    kept = (F.col("tinconf") <= F.col("toutconf")) & (F.col("toutconf") > 0) & (F.col("tinconf") < lookahead_s)
    return p.where(kept).withColumn("dcpa_m", F.sqrt("dcpa2"))


def traffic_features(states: DataFrame) -> DataFrame:
    """Per aircraft and tick: others, nearest ones and the closest approach; sentinels for an aircraft alone.

    Others are a count of the tick, the nearest in height is a neighbour in order of height, and the nearest in place and
    by closest approach are least values over blocks of a tick's aircraft, which make no row for a pair.
    """
    of_tick = states.groupBy("tick").agg(F.count_distinct("trajectory_id").alias("others"))
    by_height = Window.partitionBy("tick").orderBy("alt_m", "trajectory_id")
    gap = F.least(F.col("alt_m") - F.lag("alt_m").over(by_height), F.lead("alt_m").over(by_height) - F.col("alt_m"))
    out = states.withColumn("nearest_m", gap).join(of_tick, "tick").select("tick", "trajectory_id", (F.col("others") - 1).alias("traffic_count"), "nearest_m")
    out = out.join(closest_of_all(states, HORIZON_S), ["tick", "trajectory_id"], "left")
    return out.select(
        "tick", "trajectory_id", "traffic_count", F.coalesce("near_nm", F.lit(999.0)).alias("nearest_nm"), F.coalesce("nearest_m", F.lit(99999.0)).alias("nearest_m"),
        F.coalesce("cpa.cpa_nm", F.lit(999.0)).alias("min_cpa_nm"), F.coalesce("cpa.tcpa", F.lit(9999.0)).alias("min_tcpa_s"),
    )


def newly_seen(conflicts: DataFrame, keys: list[str], tick: str = "tick") -> DataFrame:
    """Rows whose key was not there in the tick before."""
    before = F.lag(tick).over(Window.partitionBy(*keys).orderBy(tick))
    return conflicts.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") < F.col(tick) - 1)).drop("__before")


def penetration(value: Column, outer: float, inner: float) -> Column:
    """0 at the outer border and beyond, 1 at the inner one and within."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (outer - value) / max(outer - inner, 1e-6)))


def contacts(
    states: DataFrame, horizontal_km: float = 8.0, vertical_ft_min: float = 1000.0, temporal_s: float = 90.0, lookahead_s: float = 300.0,
    observe_km: float = 40.0, collide_km: float = 0.5, collide_ft: float = 300.0, mode: str = "combined",
) -> DataFrame:
    """Directed contacts with loss, look-ahead, crossing-time and collision flags, and a severity.

    Modes are ``horizontal``, ``spatial``, ``temporal`` and ``combined``. The speed is the ground speed.
    """
    # kept are pairs within ``observe_km``, or that come near enough, or whose courses cross, within the look-ahead
    p = near_pairs(states, max(observe_km, horizontal_km, collide_km) * 1000 / geo.NM_M, flown_nm(lookahead_s), ordered=True)
    mid = F.radians((F.col("lat1") + F.col("lat2")) / 2)
    speed = lambda n: F.col(f"gs{n}") / 1000.0
    east = lambda n: speed(n) * F.sin(F.radians(f"trk{n}"))
    north = lambda n: speed(n) * F.cos(F.radians(f"trk{n}"))
    p = once(p, {
        "x": over_date_line(F.col("lon2") - F.col("lon1")) * 111.32 * F.cos(mid), "y": (F.col("lat2") - F.col("lat1")) * 110.57,
        "u1": east(1), "w1": north(1), "u2": east(2), "w2": north(2),
        "horiz_km": geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), "vert_ft": vertical_ft(),
    })
    du, dw = F.col("u2") - F.col("u1"), F.col("w2") - F.col("w1")
    vv = du**2 + dw**2
    p = once(p, {"raw_tcpa": F.when(vv > 1e-9, -(F.col("x") * du + F.col("y") * dw) / vv), "det": F.col("u2") * F.col("w1") - F.col("u1") * F.col("w2")})
    p = p.withColumn("tcpa", F.greatest(F.lit(0.0), F.least(F.lit(lookahead_s), F.coalesce("raw_tcpa", F.lit(lookahead_s)))))
    climb = (F.col("vs2") - F.col("vs1")) / 0.3048
    p = once(p, {
        "tcpa": F.col("tcpa"), "t1": F.when(F.abs("det") > 1e-9, (F.col("u2") * F.col("y") - F.col("w2") * F.col("x")) / F.col("det")),
        "t2": F.when(F.abs("det") > 1e-9, (F.col("u1") * F.col("y") - F.col("w1") * F.col("x")) / F.col("det")),
        "dcpa_km": F.sqrt((F.col("x") + du * F.col("tcpa")) ** 2 + (F.col("y") + dw * F.col("tcpa")) ** 2),
        "later_ft": F.abs((F.col("alt2") - F.col("alt1")) / 0.3048 + climb * F.col("tcpa")),
    })
    # times at which either is where the courses cross: t1 * v1 - t2 * v2 = r, by Cramer's rule
    t1, t2 = F.col("t1"), F.col("t2")
    ahead = (F.abs("det") > 1e-9) & t1.between(0, lookahead_s) & t2.between(0, lookahead_s)
    at_crossing = F.abs((F.col("alt1") + F.col("vs1") * t1 - F.col("alt2") - F.col("vs2") * t2) / 0.3048) <= vertical_ft_min
    p = once(p, {"time_gap_s": F.when(ahead, F.abs(t1 - t2)), "applicable": F.coalesce(ahead & at_crossing, F.lit(False))})
    space, flat = F.lit(mode != "temporal"), F.lit(mode == "horizontal")
    timed = F.lit(mode in ("temporal", "combined"))
    collision = (F.col("horiz_km") <= collide_km) & (F.col("vert_ft") <= collide_ft)
    loss = (space & (F.col("horiz_km") <= horizontal_km) & (flat | (F.col("vert_ft") <= vertical_ft_min))) | collision
    ahead_loss = space & (F.col("raw_tcpa") > 0) & (F.col("raw_tcpa") <= lookahead_s) & (F.col("dcpa_km") <= horizontal_km)
    ahead_loss = F.coalesce(ahead_loss & (flat | (F.col("later_ft") <= vertical_ft_min)), F.lit(False))
    late = F.coalesce(timed & F.col("applicable") & (F.col("time_gap_s") < temporal_s), F.lit(False))
    p = once(p, {"loss": loss, "predicted": ahead_loss, "temporal": late, "collision": collision})
    p = p.where(F.col("loss") | F.col("predicted") | F.col("temporal") | (F.col("horiz_km") <= observe_km))
    urgent = 0.25 + 0.75 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("tcpa") / lookahead_s))
    now_h, now_v = penetration(F.col("horiz_km"), horizontal_km, collide_km), penetration(F.col("vert_ft"), vertical_ft_min, collide_ft)
    then_h, then_v = penetration(F.col("dcpa_km"), horizontal_km, collide_km), penetration(F.col("later_ft"), vertical_ft_min, collide_ft)
    both = lambda h, v: F.when(flat, h).otherwise(F.sqrt(h * v))
    gap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("time_gap_s") / temporal_s))
    severity = F.greatest(
        F.when(F.col("loss"), both(now_h, now_v)).otherwise(0.0), F.when(F.col("predicted"), both(then_h, then_v) * urgent).otherwise(0.0),
        F.when(F.col("temporal"), gap * urgent).otherwise(0.0),
    )
    return p.withColumn("severity", severity)


def ranked_contacts(found: DataFrame, k: int = 4) -> DataFrame:
    """The first ``k`` contacts of each aircraft: losses, then crossings, then by severity and distance."""
    order = Window.partitionBy("tick", "id1").orderBy(F.desc("loss"), F.desc("temporal"), F.desc("severity"), "horiz_km", "id2")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def resolution_vectors(conflicts: DataFrame, zone_m: float = 9260.0, margin: float = 1.05) -> DataFrame:
    """Per aircraft and tick, the sum of velocity changes that push each conflict's closest approach out of the zone."""
    c = conflicts.withColumns({
        "cx": F.col("dx") + F.col("du") * F.col("tcpa"), "cy": F.col("dy") + F.col("dv") * F.col("tcpa"),
    }).withColumn("miss", F.greatest(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2), F.lit(10.0)))
    push = (zone_m * margin - F.col("miss")) / F.greatest(F.abs("tcpa"), F.lit(1.0)) / F.col("miss")
    return c.groupBy("tick", F.col("id1").alias("trajectory_id")).agg(
        F.sum(-push * F.col("cx")).alias("dve_mps"), F.sum(-push * F.col("cy")).alias("dvn_mps"), F.count("*").alias("n_conflicts")
    )
