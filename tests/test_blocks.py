"""Sums and least values over blocks of a tick's aircraft against the same over rows of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import blocks as B
from skyledger.operators import pairs as P
from skyledger.session import small_batches

SCHEMA = "tick long, trajectory_id long, lat double, lon double, alt_m double, gs_mps double, trk_deg double, vs_mps double"


@pytest.fixture(params=[5, 4096])
def states(spark, monkeypatch, request):
    """Two ticks with unknown values, in blocks of few rows and in one."""
    monkeypatch.setattr(B, "BLOCK_ROWS", request.param)
    rng = np.random.default_rng(11)
    rows = [(k % 2, k, 30 + rng.random(), float((179.6 + rng.random() + 180) % 360 - 180), 9000.0 + 300 * (k % 4), float(rng.choice([0.0, 180.0, 240.0])), float(rng.integers(0, 36) * 10), float(k % 3 - 1)) for k in range(70)]
    rows += [(0, 900, None, 179.9, 9000.0, 200.0, 1.0, 1.0), (0, 901, 30.5, 179.9, 9000.0, None, 1.0, 1.0), (1, 902, 30.5, 179.9, None, 200.0, 1.0, 1.0), (None, 903, 30.5, 179.9, 9000.0, 200.0, 1.0, 1.0), (7, 904, 30.5, 179.9, 9000.0, 200.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *names):
    return sorted(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def test_traffic_features_by_blocks(spark, states):
    p = P.with_cpa(P.pairs(states, ordered=True))
    want = p.groupBy("tick", "id1").agg(F.min("now_nm").alias("near"), F.min("cpa_nm").alias("cpa")).where("near is not null")
    with small_batches(spark, 3):
        found = P.traffic_features(states).where("nearest_nm < 999")
        got = rows(found, "tick", "trajectory_id", "nearest_nm", F.when(F.col("min_cpa_nm") < 999, F.col("min_cpa_nm")))
    assert got == rows(want, "tick", "id1", "near", "cpa") and len(got) > 60
    assert P.traffic_features(states.limit(0)).count() == 0


def test_close_approaches_by_blocks(spark, states):
    from skyledger.functions import geo

    p = P.with_cpa(P.pairs(states)).where(P.vertical_ft() < 1000)
    d = p.where("cpa_nm < 5")
    bucket = lambda x, w: F.bround(x / w).cast("long")
    edge = d.groupBy("tick", bucket(F.abs(geo.wrap180(F.col("trk1") - F.col("trk2"))), 15).alias("turn"), bucket(P.vertical_ft(), 500).alias("height"), bucket(F.col("tcpa"), 30).alias("time"))
    names = ("tick", "turn", "height", "time", "n", "min_tcpa")
    assert rows(B.edge_kinds(states, 5.0), *names) == rows(edge.agg(F.count("*").alias("n"), F.min("tcpa").alias("min_tcpa")), *names)
    each = d.select("tick", F.explode(F.array("id1", "id2")).alias("id"), "tcpa").groupBy("tick", "id").agg(F.count("*").alias("degree"), F.min("tcpa").alias("min_tcpa"))
    names = ("tick", "id", "degree", "min_tcpa")
    assert rows(B.approach_degrees(states, 5.0), *names) == rows(each, *names)
    kinds = p.where("cpa_nm < 20").groupBy(P.geometry().alias("geometry"), P.risk(F.col("tcpa") / 60, F.col("cpa_nm"), F.col("now_nm")).alias("risk"))
    names = ("geometry", "risk", "n", "min_cpa", "min_tcpa")
    assert rows(B.approach_kinds(states, 20.0, 5.0), *names) == rows(kinds.agg(F.count("*").alias("n"), F.min("cpa_nm").alias("min_cpa"), F.min("tcpa").alias("min_tcpa")), *names)
    mine = p.where("cpa_nm < 20").withColumn("g", P.geometry()).select("tick", F.explode(F.array("id1", "id2")).alias("id"), "g", ((F.col("g") != "head_on") & ((F.col("tcpa") / 60 <= 3) | (F.col("cpa_nm") < 3))).alias("u"))
    names = ("tick", "id", *[f"of_{g}" for g in B.GEOMETRIES], "urgent")
    want = mine.groupBy("tick", "id").agg(*[F.count_if(F.col("g") == g).alias(f"of_{g}") for g in B.GEOMETRIES], F.count_if("u").alias("urgent"))
    assert rows(B.approach_context(states, 20.0), *names) == rows(want, *names)
    assert B.edge_kinds(states.limit(0), 5.0).count() == 0


def test_risks_of_all_pairs_by_blocks(spark, states):
    p = P.with_cpa(P.pairs(states))
    want = p.groupBy("tick", P.risk(F.col("tcpa") / 60, F.col("cpa_nm"), F.col("now_nm")).alias("risk")).agg(F.count("*").alias("n"))
    assert rows(B.pair_risks(states, 5.0), "tick", "risk", "n") == rows(want, "tick", "risk", "n")


def test_text_of_edges_is_hashed_in_pieces():
    from hashlib import sha256

    from skyledger.operators.policy_queries import hashed_edges

    edges = [("1,2", 1), ("10,0", 9000), ("3,1", 4097)]
    text = ";".join(e for e, n in edges for _ in range(n))
    assert hashed_edges(edges) == sha256(text.encode()).hexdigest()[:24] and hashed_edges([]) == sha256(b"").hexdigest()[:24]


def test_counts_of_pairs_without_pairs(spark, states):
    states = states.unionByName(states.where("trajectory_id in (3, 8, 904)"))
    names = ("tick", "n_pairs", "ids1", "ids2")
    want = P.pairs(states).groupBy("tick").agg(F.count("*").alias("n_pairs"), F.sum("id1").alias("ids1"), F.sum("id2").alias("ids2"))
    assert rows(P.pair_totals(states), *names) == rows(want, *names)
    names = ("tick", "id1", "n_others", "first_id", "last_id")
    want = P.pairs(states, ordered=True).groupBy("tick", "id1").agg(F.count("*").alias("n_others"), F.min("id2").alias("first_id"), F.max("id2").alias("last_id"))
    found = P.others(states)
    assert rows(found, *names) == rows(want, *names)


def test_losses_by_blocks(spark, states):
    from skyledger.plans.components import connected_components

    p = P.with_relative(P.pairs(states)).withColumn("ft", P.vertical_ft()).where("now_nm < 5 and ft < 1000")
    want = p.groupBy("tick").agg(F.count("*").alias("n"), F.min("now_nm").alias("min_nm"), F.min("ft").alias("min_ft"))
    assert rows(B.losses(states, 5.0, 1000.0), "tick", "n", "min_nm", "min_ft") == rows(want, "tick", "n", "min_nm", "min_ft")
    groups = lambda e, **how: rows(connected_components(e.select((F.col("tick") * 1000 + F.col("id1")).alias("a"), (F.col("tick") * 1000 + F.col("id2")).alias("b")), "a", "b", **how), "node", "component")
    links = B.loss_links(states, 5.0, 1000.0)
    assert groups(links) == groups(p) == groups(p, crowded=True) and p.count() > links.count() or B.BLOCK_ROWS < 100


def test_links_of_a_crowd_are_contracted():
    from skyledger.plans.components import local_stars

    u, v = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    node, least = local_stars(np.concatenate([u, np.arange(100, 900)]), np.concatenate([v, np.arange(101, 901)]))
    assert dict(zip(node.tolist(), least.tolist())) == dict.fromkeys(range(1, 50), 0) | dict.fromkeys(range(101, 901), 100)


def test_rows_of_pairs_by_blocks(spark, states):
    """Results that are pairs come from blocks, strip by strip, with what is unknown as null."""
    p = P.with_cpa(P.pairs(states))
    names = ("tick", "id1", "id2", "tcpa", "cpa_nm", "now_nm")
    with small_batches(spark, 3):
        assert rows(B.all_approaches(states).fillna(-1.0), *names) == rows(p.fillna(-1.0), *names)
        near = p.withColumn("vsep_ft", P.vertical_ft()).where("cpa_nm < 20 and vsep_ft < 1000")
        names = ("tick", "id1", "id2", "tcpa", "cpa_nm", "vsep_ft")
        assert rows(B.close_approaches(states, 20.0, 1000.0), *names) == rows(near, *names)
        assert rows(B.pair_geometries(states, 20.0), "geometry", "n") == rows(p.groupBy(P.geometry().alias("geometry")).agg(F.count("*").alias("n")), "geometry", "n")
    assert B.all_approaches(states.limit(0)).count() == 0


def test_roll_outs_by_blocks(spark, states):
    from skyledger.operators import policy as L

    even = F.col("trajectory_id") % 2 == 0
    acting = states.where("lat is not null and gs_mps is not null and alt_m is not null").withColumns({"kind": F.when(even, "speed").otherwise("altitude"), "target": F.when(even, 400.0).otherwise(9900.0)})
    p = P.pairs(acting, ordered=True).withColumns({"kind": F.when(F.col("id1") % 2 == 0, "speed").otherwise("altitude"), "target": F.when(F.col("id1") % 2 == 0, 400.0).otherwise(9900.0)})
    want = L.rollout(p).withColumnRenamed("min_m_when_lost", "min_m").fillna(-1.0)
    names = ("tick", "id1", "id2", "min_nm", "min_m", "unsafe")
    with small_batches(spark, 3):
        got = rows(L.rollouts(acting).fillna(-1.0), *names)
        checked = rows(B.plans_checked(acting.withColumn("kind", F.lit("hold")), L.motion_terms(), L.straight_on, L.grid(), 5.0, 300.0), "tick", "checked", "unsafe", "min_nm")
    assert got == rows(want, *names) and any(r[5] for r in got)
    still = L.rollout(P.pairs(acting).withColumns({"kind": F.lit("hold"), "target": F.lit(0.0)})).groupBy("tick")
    assert checked == rows(still.agg(F.count("*").alias("checked"), F.count_if("unsafe").alias("unsafe"), F.min("min_nm").alias("min_nm")), "tick", "checked", "unsafe", "min_nm")


def test_edges_between_ranks_are_hashed_in_order(spark, states, monkeypatch):
    from hashlib import sha256

    monkeypatch.setattr(B, "HELD_EDGES", 40)
    ranked = states.withColumn("role", (F.col("trajectory_id") * 37) % 997)  # one to three digits, in another order than ids
    d = P.with_cpa(P.pairs(states)).where((P.vertical_ft() < 1000) & (F.col("cpa_nm") < 5))
    want = {}
    for tick, one, two, time in d.select("tick", *[(F.col(i) * 37) % 997 for i in ("id1", "id2")], F.bround(F.col("tcpa") / 60).cast("long")).collect():
        want.setdefault(tick, []).append(f"{min(one, two)},{max(one, two)},{time}")
    want = {tick: sha256(";".join(sorted(e)).encode()).hexdigest()[:24] for tick, e in want.items()}
    edges = B.ranked_edges(ranked, 5.0, 60.0)
    assert dict(map(tuple, B.edges_hashed(edges, 60.0).collect())) == want and len(want) == 2
    assert edges.count() < d.count() and B.edges_hashed(edges.limit(0), 60.0).count() == 0
    numbers = np.array([0, 1, 10, 100, 11, 2, 20, 999, 1234567, 99999999])
    assert numbers[np.argsort(B.text_order(numbers))].tolist() == sorted(numbers.tolist(), key=str)


@pytest.mark.parametrize("crowd", [1, 12])
def test_contacts_by_blocks(spark, states, crowd, monkeypatch):
    """In a crowd, where most have more losses than are ranked, and where few have any."""
    from skyledger.operators import contact_blocks as C

    monkeypatch.setattr(B, "HELD_EDGES", 50)
    lon = F.signum("lon") * (180 - (180 - F.abs("lon")) / crowd)
    states = states.withColumns({"lat": 30 + (F.col("lat") - 30) / crowd, "lon": lon}).where("alt_m is not null")
    found = P.contacts(states).withColumns({n: F.round(n, 9) for n in ("severity", "horiz_km")}).localCheckpoint()
    flagged = found.where("loss or predicted or temporal")
    with small_batches(spark, 3):
        names = ("tick", "id1", "id2", "loss", "predicted", "temporal", "collision", "severity")
        assert rows(C.contact_rows(states), *names) == rows(flagged, *names)
        names = ("tick", "id1", "id2", "time_gap_s", "applicable")
        close = lambda df: [(*r[:3], round(r[3], 6), r[4]) for r in rows(df, *names)]
        assert close(C.contact_rows(states, flagged=False)) == close(found.where("time_gap_s is not null"))
        first = C.first_contacts(states)
        names = ("tick", "id1", "id2", "rank")
        assert rows(P.ranked_contacts(first), *names) == rows(P.ranked_contacts(found), *names)
    many = found.where("loss").groupBy("tick", "id1").count().where("count > 4").count()
    assert many > 20 if crowd > 1 else many < 20
    names = ("tick", "id1", "n_contacts", "n_lost", "severity")
    for some, one in ((found, False), (flagged, True)):
        want = some.groupBy("tick", "id1").agg(F.count("*").alias("n_contacts"), F.count_if("loss").alias("n_lost"), F.max("severity").alias("severity"))
        assert rows(C.contact_sums(states, flagged=one), *names) == rows(want, *names)
    assert C.first_contacts(states.limit(0)).count() == C.contact_sums(states.limit(0)).count() == 0


def test_neighbourhoods_by_blocks(spark, states):
    """Also of aircraft at one place with one course."""
    from skyledger.functions import geo

    states = states.unionByName(states.where("trajectory_id < 9").withColumns({"trajectory_id": F.col("trajectory_id") + 2000, "gs_mps": F.col("gs_mps") + 7}))
    own = states.where("lat is not null and tick is not null")
    own = P.with_relative(P._side(own, 1).withColumns({f"{n}2": F.col(f"{n}1") for n in ("id", *P.SHORT.values())}))
    p = P.with_relative(P.pairs(states, ordered=True)).unionByName(own).where((F.col("now_nm") <= 15) & (F.abs(geo.wrap180(F.col("trk2") - F.col("trk1"))) <= 90))
    want = p.groupBy("tick", F.col("id1").alias("trajectory_id")).agg(F.count("*").alias("n_near"), *[F.avg(f"{n}2").alias(f"mean_{n}") for n in ("gs", "vs", "lat", "lon")])
    names = ("tick", "trajectory_id", "n_near", "mean_gs", "mean_vs", "mean_lat", "mean_lon")
    assert rows(B.neighbourhoods(states, 15.0, 90.0), *names) == rows(want, *names) and want.where("n_near > 3").count() > 9
    assert B.neighbourhoods(states.limit(0), 15.0, 90.0).count() == 0


def test_plans_of_groups_by_blocks(spark, states):
    """Sums and least values of blocks give the plans that rows of all pairs give."""
    from skyledger.operators import plan_blocks
    from skyledger.operators import resolve as R

    known = states.where("lat is not null and gs_mps is not null and alt_m is not null and tick is not null and trajectory_id < 12 or tick = 0 and trajectory_id in (30, 34)")
    groups = known.withColumns({"component": F.col("trajectory_id") % 4 - F.col("trajectory_id") % 2, "lat0": F.lit(30.4), "lon": F.lit(103.0) + F.col("lat") / 9})
    side = lambda n: P._side(groups, n).join(groups.select("tick", F.col("trajectory_id").alias(f"id{n}"), "component", "lat0"), ["tick", f"id{n}"])
    p = side(1).join(side(2).drop("lat0"), ["tick", "component"]).where("id1 < id2")
    names = ("tick", "component", "who", "what", "losses", "min_km", "min_ft", "score")
    rounded = lambda df: df.withColumns({n: F.round(n, 6) for n in names[5:]})
    assert rows(rounded(plan_blocks.group_plans(groups)), *names) == rows(rounded(R.group_plans(p)), *names) and p.count() > 9


def test_plans_are_verified_for_twenty_minutes(spark, states):
    """Every two seconds of them, by closest approaches in ranges of times, as by going through the grid for all pairs."""
    from skyledger.operators import grid_blocks as G
    from skyledger.operators import policy as L
    from skyledger.operators.extra_queries import planned

    times = L.grid(L.VERIFY_HORIZON_S, L.VERIFY_STEP_S)
    assert len(times) == 601 and times[:2] == [0.0, 2.0] and times[-1] == 1200.0 and L.VERIFY_RANGES[0][0] == 0 and L.VERIFY_RANGES[-1][1] == 600
    names = ("tick", "checked", "unsafe", "min_nm")
    # crowded, in one line, and far apart, where none is near enough to be unsafe
    for each in (states, states.withColumn("lat", F.lit(30.5)), states.withColumns({"lat": F.col("lat") + F.col("trajectory_id") % 7 * 8, "trk_deg": F.lit(90.0)})):
        acting = each.withColumns(planned())
        got = rows(G.plans_checked(acting, L.motion_terms(), L.moved, times, L.VERIFY_RANGES, 5.0, 300.0), *names)
        assert got == rows(B.plans_checked(acting, L.motion_terms(), L.moved, times, 5.0, 300.0), *names) and len(got) == 2
    assert G.plans_checked(acting.limit(0), L.motion_terms(), L.moved, times, L.VERIFY_RANGES, 5.0, 300.0).count() == 0


def test_roles_go_by_seven_keys(spark, states, monkeypatch):
    """Aircraft with equal degrees are told apart by severity, time, height, speed and course before their ids."""
    from skyledger.operators import contact_blocks as C
    from skyledger.operators import policy_queries as Q

    known = states.where("alt_m is not null and tick is not null")
    d = P.with_cpa(P.pairs(known)).where((P.vertical_ft() < 1000) & (F.col("cpa_nm") < 5))
    severe = P.contacts(known).where("id1 < id2").select("tick", "id1", "id2", "severity")
    each = d.join(severe, ["tick", "id1", "id2"], "left").select("tick", F.explode(F.array("id1", "id2")).alias("id"), "tcpa", F.coalesce("severity", F.lit(0.0)).alias("severity"))
    names = ("tick", "id", "degree", "min_tcpa", "severity")
    want = each.groupBy("tick", "id").agg(F.count("*").alias("degree"), F.min("tcpa").alias("min_tcpa"), F.max("severity").alias("severity"))
    assert rows(C.approach_roles(known, 5.0), *names) == rows(want, *names) and want.where("severity > 0").count() > 9
    # five pairs, far from each other; ids are in the opposite order of what is to decide
    at = lambda k, tick, lat, gap, alt, gs, trk: [(tick, k, lat, 104.0, alt, gs, trk, 0.0), (tick, k + 1, lat + gap, 104.0, alt, gs, trk, 0.0)]
    made = [*at(30, 0, 30.0, 0.05, 9000.0, 200.0, 0.0), *at(20, 0, 31.0, 0.05, 9000.0, 200.0, 60.0), *at(10, 0, 32.0, 0.05, 9000.0, 180.0, 0.0), *at(5, 0, 33.0, 0.05, 8000.0, 250.0, 0.0), *at(1, 0, 34.0, 0.07, 12000.0, 250.0, 0.0)]
    monkeypatch.setattr(Q.A, "tracks", lambda spark, folder: spark.createDataFrame(made, SCHEMA))
    roles = dict(Q.role_order(spark, "").select("role", "id").collect())
    assert [roles[k] for k in sorted(roles)] == [30, 31, 20, 21, 10, 11, 5, 6, 1, 2]


def test_counts_and_first_ones_of_traffic_by_blocks(spark, states):
    """What lies near, converges, takes a level or comes first, as rows of all pairs give it, and no rows of pairs leave their blocks for it."""
    from skyledger.functions import geo
    from skyledger.operators import traffic_blocks as T

    states = states.where("tick is not null")
    p, both = P.with_cpa(P.pairs(states)).localCheckpoint(), P.with_relative(P.pairs(states, ordered=True)).localCheckpoint()
    with small_batches(spark, 3):
        want = p.where((F.col("cpa_nm") < 20) & (F.abs(F.col("alt1") - F.col("alt2")) < 650)).groupBy("tick").agg(F.count("*").alias("n"))
        assert rows(T.approach_counts(states, 20.0, 650.0), "tick", "n") == rows(want, "tick", "n")
        want = p.where("cpa_nm < 20 and tcpa > 0").groupBy("tick").agg(F.round(F.sum(F.sqrt(2 + F.col("cpa_nm") ** 2)), 6).alias("convergence"), F.count("*").alias("n"))
        names = ("tick", "convergence", "n")
        assert rows(T.convergence(states, 20.0).withColumn("convergence", F.round("convergence", 6)), *names) == rows(want, *names)
        names = ("tick", "id1", "id2", "now_nm")
        assert rows(T.within_radius(states, 12.0), *names) == rows(p.where("now_nm <= 12"), *names)
        order = F.row_number().over(P.Window.partitionBy("tick").orderBy(F.round("tcpa", 4), F.round("now_nm", 6), "id1", "id2"))
        first = lambda df: rows(df.withColumn("n", order).where("n <= 3"), "tick", "id1", "id2", "n")
        assert first(T.first_approaches(states, 5.0, 3)) == first(p.where("cpa_nm < 5"))
        h, b = F.round(geo.compass(F.col("trk2") - F.col("trk1")), 9), F.round(geo.compass(geo.bearing(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))) - F.col("trk1")), 9)
        rule = F.when(h.between(160, 200), "head_on").when((h <= 20) | (h >= 340), "overtake").when(b < 180, "crossing_right").otherwise("crossing_left")
        assert rows(T.encounter_rules(states), "rule", "n") == rows(both.groupBy(rule.alias("rule")).agg(F.count("*").alias("n")), "rule", "n")
        there = F.abs(F.col("alt2") - (F.col("at") * 600 + 8100)) < 304.8
        want = both.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(6)))).groupBy("tick", "id1", "at")
        want = want.agg(F.count_if(there & (F.col("now_nm") < 40)).alias("near"), F.count_if(there & (F.col("now_nm") < 10)).alias("close"))
        names = ("tick", "id1", "at", "near", "close")
        assert rows(T.levels_taken(states, tuple(range(8100, 12001, 600)), 304.8, 40.0, 10.0), *names) == rows(want, *names)
        near = both.where((F.abs(F.col("alt1") - F.col("alt2")) < 600) & (F.col("now_nm") < 40))
        half = F.degrees(F.asin(F.least(F.lit(1.0), 5.0 / F.greatest(F.col("now_nm"), F.lit(5.0)))))
        mid = geo.wrap180(geo.bearing(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))) - F.col("trk1"))
        want = {}
        for tick, one, m, w in near.select("tick", "id1", F.round(mid, 6), F.round(half, 6)).collect():
            if m is not None and m - w < 90 and m + w > -90:
                want.setdefault((tick, one), []).append((max(-90.0, m - w), min(90.0, m + w)))
        length = lambda of: round(sum(b - a for _, a, b in zip(*T.united(np.zeros(len(of), np.int64), *map(np.array, zip(*of))))), 4)
        got = {}
        for tick, one, a, b in T.bands(states, 40.0, 600.0, 5.0).collect():
            got.setdefault((tick, one), []).append((a, b))
        assert {k: length(v) for k, v in got.items()} == {k: length(v) for k, v in want.items()} and len(got) > 60
    for made in (T.approach_counts, T.convergence):
        assert made(states.limit(0), 20.0, 650.0).count() == 0


def test_bands_are_united():
    from skyledger.operators.traffic_blocks import united

    row, low, high = united(np.array([4, 1, 1, 1, 4, 1]), np.array([0.0, -90, -80, 20, 0.5, 10]), np.array([1.0, -50, -70, 30, 0.7, 20]))
    assert [row.tolist(), low.tolist(), high.tolist()] == [[1, 1, 4], [-90.0, 10.0, 0.0], [-50.0, 30.0, 1.0]]
    assert len(united(row[:0], low[:0], high[:0])[0]) == 0


def test_sides_are_told_where_bearings_are_at_their_limits(spark):
    """Dead ahead, dead astern and at one place, where the sign of a product says nothing."""
    from skyledger.functions import geo
    from skyledger.operators import traffic_blocks as T

    made = [(0, 1, 30.0, 104.0, 9000.0, 200.0, 0.0, 0.0), (0, 2, 31.0, 104.0, 9000.0, 200.0, 90.0, 0.0), (0, 3, 30.0, 104.0, 9000.0, 200.0, 250.0, 0.0), (0, 4, 29.0, 104.0, 9000.0, 200.0, 300.0, 0.0), (0, 5, 30.0, 104.0, 9000.0, 200.0, 45.0, 0.0)]
    states = spark.createDataFrame(made, SCHEMA)
    both = P.pairs(states, ordered=True)
    h, b = F.round(geo.compass(F.col("trk2") - F.col("trk1")), 9), F.round(geo.compass(geo.bearing(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))) - F.col("trk1")), 9)
    rule = F.when(h.between(160, 200), "head_on").when((h <= 20) | (h >= 340), "overtake").when(b < 180, "crossing_right").otherwise("crossing_left")
    assert rows(T.encounter_rules(states), "rule", "n") == rows(both.groupBy(rule.alias("rule")).agg(F.count("*").alias("n")), "rule", "n")


def test_directed_conflicts_by_blocks(spark, states):
    """Over the date line, far apart and near a pole, with unknown heights and speeds, as by a join on cells; and what is new in a tick."""
    from skyledger.operators import conflict_blocks as D

    states = states.where("tick is not null")
    again = states.where("trajectory_id % 3 > 0").withColumns({"tick": F.col("tick") + 1, "lat": F.col("lat") + 0.01})
    states = states.where("tick in (0, 7)").unionByName(again.where("tick = 1")).unionByName(states.where("tick = 0 and trajectory_id % 2 = 0").withColumn("tick", F.lit(2).cast("long")))
    # fast ones on both sides of the earth, and some about a pole
    more = [(5, 1, 0.0, 0.0, 9000.0, 6000.0, 90.0, 0.0), (5, 2, 0.0, 14.0, 9000.0, 6000.0, 270.0, 0.0), (5, 3, -60.0, 120.0, 9000.0, 200.0, 0.0, 0.0), (5, 4, 30.0, 170.0, 9000.0, 200.0, 0.0, 0.0)]
    more += [(6, k, 89.7, 60.0 * k, 9000.0 + k * 2000, 230.0, 40.0 * k, -7.0 * k) for k in range(6)]
    states = states.unionByName(spark.createDataFrame(more, SCHEMA))
    found = P.directed_conflicts(states).localCheckpoint()
    assert found.where("tick = 5").count() and found.where("tick = 6").count() and found.count() > 60
    names = ("tick", "id1", "id2", "qdr", "dist_m", "tcpa", "tinconf")
    near = lambda df: [(*r[:3], *[round(x, 4) for x in r[3:]]) for r in rows(df, *names)]
    with small_batches(spark, 3):
        assert near(D.conflict_rows(states)) == near(found)
        pairs = found.select("tick", F.least("id1", "id2").alias("low"), F.greatest("id1", "id2").alias("high")).distinct()
        names = ("tick", "low", "high")
        assert rows(D.conflict_pairs(states), *names) == rows(pairs, *names)
        new = P.newly_seen(pairs, ["low", "high"])
        assert rows(D.fresh_pairs(states), *names) == rows(new, *names) and new.count() < pairs.count()
        want = pairs.groupBy("tick").agg(F.count("*").alias("n_now")).join(new.groupBy("tick").agg(F.count("*").alias("n_new")), "tick", "left").fillna(0)
        assert rows(D.conflict_counts(states), "tick", "n_now", "n_new") == rows(want, "tick", "n_now", "n_new")
        names = ("tick", "trajectory_id", "dve_mps", "dvn_mps", "n_conflicts")
        sums = lambda df: [(*r[:2], round(r[2], 4), round(r[3], 4), r[4]) for r in rows(df, *names)]
        assert sums(D.conflict_vectors(states)) == sums(P.resolution_vectors(found))
    assert D.conflict_pairs(states.limit(0)).count() == D.conflict_counts(states.limit(0)).count() == D.conflict_vectors(states.limit(0)).count() == 0


def test_first_unsafe_ones_by_blocks(spark, states):
    """They are those of the roll-outs of all ordered pairs, of which no row is made."""
    from skyledger.operators import policy as L

    even = F.col("trajectory_id") % 2 == 0
    acting = states.where("tick is not null").withColumns({"lat": 30 + (F.col("lat") - 30) / 6, "kind": F.when(even, "speed").otherwise("altitude"), "target": F.when(even, 400.0).otherwise(9900.0)})
    u = L.rollouts(acting).where("unsafe").groupBy("tick", "id1")
    want = u.agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("id2")), 1, 3).alias("ids")).withColumn("ids", F.col("ids").cast("string"))
    got = L.first_unsafe(acting, 3).withColumn("ids", F.col("ids").cast("string"))
    assert rows(got, "tick", "id1", "n", "ids") == rows(want, "tick", "id1", "n", "ids") and want.where("n > 3").count() > 9
    assert L.first_unsafe(acting.limit(0), 3).count() == 0


def test_samples_have_all_edges_without_a_join_of_pairs(spark, states, monkeypatch):
    import json

    from skyledger.operators import more_queries as M

    known = states.where("tick is not null")
    monkeypatch.setattr(M.A, "tracks", lambda spark, folder: known)
    monkeypatch.setattr(P, "near_pairs", None)
    got = {r["tick"]: (r["n_edges"], json.loads(r["sample"])) for r in M.training_samples(spark, "").collect()}
    d = P.with_cpa(P.pairs(known)).where((P.vertical_ft() < 1000) & (F.col("cpa_nm") < 5)).select("tick", "id1", "id2", F.round("tcpa", 3))
    for tick, (n, sample) in got.items():
        want = sorted(tuple(r)[1:] for r in d.where(F.col("tick") == tick).collect())
        assert [tuple(e.values()) for e in sample.get("edges", [])] == want and n == len(want)
    assert sorted(got) == [0, 1, 7] and got[0][0] > 9
