"""Literal cases, and properties that hold for any data."""

from __future__ import annotations

import itertools

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.functions import aero, geo, text
from skyledger.operators import evaluate as E
from skyledger.operators import pairs as P
from skyledger.operators.policy_queries import gate
from skyledger.plans.components import connected_components
from skyledger.sources import adapters as A


def one(spark, **columns):
    return spark.range(1).select(*[x.alias(n) for n, x in columns.items()]).first()


def test_geodesy_of_known_places(spark):
    here, there = (F.lit(52.309), F.lit(4.764)), (F.lit(51.470), F.lit(-0.454))
    r = one(spark, d=geo.distance_nm(*here, *there), k=geo.haversine_km(*here, *there), f=geo.flat_distance_nm(*here, *there), w=geo.wrap180(F.lit(190.0)), c=geo.compass(F.lit(-10.0)))
    assert abs(r["k"] - 370.5) < 2 and abs(r["d"] * 1.852 - r["k"]) < 1 and abs(r["f"] - r["d"]) < 1
    assert r["w"] == -170.0 and r["c"] == 350.0


def test_destination_is_the_inverse_of_distance(spark):
    lat, lon = geo.destination(F.lit(30.0), F.lit(103.0), F.lit(70.0), F.lit(80.0))
    r = one(spark, d=geo.distance_nm(F.lit(30.0), F.lit(103.0), lat, lon), q=geo.bearing(F.lit(30.0), F.lit(103.0), lat, lon))
    assert abs(r["d"] - 80) < 0.1 and abs(r["q"] - 70) < 1e-6


def test_atmosphere_and_speeds(spark):
    h = F.lit(10_000.0)
    r = one(spark, t=aero.temperature(h), p=aero.pressure(h), rho=aero.density(h), back=aero.tas_to_cas(aero.cas_to_tas(F.lit(130.0), h), h), x=aero.crossover_altitude(F.lit(154.3), F.lit(0.78)))
    assert abs(r["t"] - 223.15) < 0.01 and abs(r["p"] - 26_436) < 30 and abs(r["rho"] - 0.4127) < 0.001
    assert abs(r["back"] - 130) < 1e-6 and 8_000 < r["x"] < 10_500


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("ALT_M CES1234,3000,CLIMB", ("altitude", "CES1234", 3000.0, "m", "climb")), ("ALT CES1234,FL310,2000", ("altitude", "CES1234", 9448.8, "m", None)),
        ("SPD CES1234,250", ("speed", "CES1234", 250.0, "kt", "set_speed")), ("HDG CES1234,090", ("heading", "CES1234", 90.0, "deg", "set_heading")), ("GO HOME", None),
    ],
)
def test_commands(spark, command, want):
    got = one(spark, p=text.parsed_command(F.lit(command)))["p"]
    assert (tuple(got) if got else None) == want


def test_text_functions(spark):
    r = one(
        spark, a=text.callsign(F.lit(" ces-12 34")), b=text.callsign(F.lit("ABC")), c=text.spoken_digits(F.lit("洞幺 两")), d=text.metric_level(F.lit("S0600")),
        e=text.planned_speed_kt(F.lit("N0430")), f=text.altitude_ft(F.lit("fl310")), g=text.altitude_ft(F.lit("?")), h=text.clock_seconds(F.lit("01:02:03.5")),
        i=text.coordinate(F.lit("N52'30'0")), j=text.coordinate(F.lit("W4'15'0")), k=text.iso_epoch(F.lit("1970-01-01T00:01:00Z")), m=text.latitude_text(F.lit(-30.26)),
    )
    assert tuple(r) == ("CES1234", None, "012", 6000.0, 430.0, 31000.0, -1e9, 3723.5, 52.5, -4.25, 60.0, "S30'15'36.0")


def frame(times, family="altitude"):
    return pd.DataFrame({"event_id": range(len(times)), "callsign": "A1", "family": family, "target": 0.0, "unit": "m", "epoch": [float(t) for t in times]})


@given(st.lists(st.integers(0, 300), max_size=5), st.lists(st.integers(0, 300), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ordered_matching_is_the_best_there_is(a, b):
    a, b = sorted(a), sorted(b)
    found = E.ordered_pairs(frame(a), frame(b), 60.0, False)
    assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(found))
    best = (0, 0.0)
    for k in range(min(len(a), len(b)) + 1):
        for left in itertools.combinations(range(len(a)), k):
            for right in itertools.combinations(range(len(b)), k):
                gaps = [abs(a[i] - b[j]) for i, j in zip(left, right)]
                if all(g <= 60 for g in gaps):
                    best = max(best, (k, -float(sum(gaps))))
    assert (len(found), -float(sum(abs(a[i] - b[j]) for i, j in found))) == best


def test_matching_identity_borders_and_emptiness():
    a = frame([0, 100, 200])
    assert E.ordered_pairs(a, a, 60.0, False) == [(0, 0), (1, 1), (2, 2)]
    assert E.ordered_pairs(frame([0]), frame([60]), 60.0, False) == [(0, 0)] and E.ordered_pairs(frame([0]), frame([61]), 60.0, False) == []
    assert E.ordered_pairs(frame([0]), frame([0, 1, 2]), 60.0, False) == [(0, 0)]
    assert E.greedy_pairs(frame([0, 10]), frame([9]), 60.0) == [(0, 0)]


def test_acceptance_literal_case(spark):
    rows = [("action_executed", 0, "", False), ("action_executed", 3, "ALT", True), ("action_executed", 3, "ALT", False), ("command_failed", 2, "HDG", False)]
    events = spark.createDataFrame([(*r, "m") for r in rows], "event string, macro_action long, command string, command_applied boolean, message string")
    by = {r["name"]: (r["submitted"], r["accepted"], r["rejected"], r["rate"]) for r in E.acceptance_by_macro(events).collect()}
    assert by == {"resume": (0, 0, 0, None), "heading": (1, 0, 1, 0.0), "altitude": (1, 1, 0, 1.0), "speed": (0, 0, 0, None)}


def test_separation_literal_cases(spark):
    events = spark.createDataFrame([("separation_updated", 2, 7.408, 9.26), ("separation_updated", 3, 9.26, 9.26), ("other", 2, 1.0, 2.0), ("separation_updated", 9, 9.0, 8.0)], "event string, episode long, previous_horizontal_km double, horizontal_km double")
    outcomes = spark.createDataFrame([(1, 2, 0), (2, 2, 1), (3, 3, 1)], "row_id long, episode long, safe_success int")
    got = {r["episode"]: (r["change"], r["eligible"], r["success"], r["why_not"]) for r in E.separation_changes(events, outcomes).collect()}
    assert got == {2: ("tightened", True, True, ""), 3: ("unchanged", False, False, "no change"), 9: ("relaxed", False, False, "no diagnostics")}


def test_islands_do_not_change_the_matching(spark, data):
    refs, own = A.references(spark, data), A.system_commands(spark, data)
    found = {(r["ref_id"], r["sys_id"]) for r in E.match_ordered(refs, own, 7200.0).collect()}
    a, b, want = refs.toPandas(), own.toPandas(), set()
    for name in set(a.callsign) & set(b.callsign):
        x, y = (d[d.callsign == name].sort_values(["epoch", "event_id"], ignore_index=True) for d in (a, b))
        want |= {(x.event_id[i], y.event_id[j]) for i, j in E.ordered_pairs(x, y, 7200.0, False)}
    assert found == want and found


def test_grid_join_equals_all_pairs(spark, data):
    states = A.tracks(spark, data)
    keys = ["tick", "id1", "id2"]
    near = {tuple(r) for r in P.pairs_within(states, 9.0).select(*keys).collect()}
    every = {tuple(r) for r in P.with_relative(P.pairs(states)).where("now_nm <= 9").select(*keys).collect()}
    assert near == every and near


def test_components_of_chains_stars_and_odd_edges(spark):
    rows = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    want = dict.fromkeys(range(1, 61), 1) | dict.fromkeys(range(100, 140), 100) | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cooldowns():
    rows = pd.DataFrame([("A1", 1, "altitude", 9000.0, 0.0), ("A1", 2, "speed", 250.0, 100.0), ("A1", 3, "altitude", 9600.0, 8000.0), ("A1", 4, "altitude", 9000.0, 20000.0), ("A1", 5, "speed", 250.0, 30000.0)], columns=["callsign", "event_id", "family", "target", "epoch"])
    assert gate(rows)["reason"].tolist() == ["", "aircraft cooldown", "axis cooldown", "repeated target", ""]


def test_conflict_of_a_head_on_pair(spark):
    states = spark.createDataFrame([(0, 1, 30.0, 103.0, 9000.0, 230.0, 90.0, 0.0), (0, 2, 30.0, 103.5, 9000.0, 230.0, 270.0, 0.0), (0, 3, 35.0, 103.5, 9000.0, 230.0, 270.0, 0.0)], "tick long, trajectory_id long, lat double, lon double, alt_m double, gs_mps double, trk_deg double, vs_mps double")
    got = P.directed_conflicts(states).select("id1", "id2", "tcpa").collect()
    assert sorted((r["id1"], r["id2"]) for r in got) == [(1, 2), (2, 1)]
    assert all(90 < r["tcpa"] < 120 for r in got)
    alone = {r["trajectory_id"]: r for r in P.traffic_features(states.where("trajectory_id = 3")).collect()}
    assert alone[3]["traffic_count"] == 0 and alone[3]["nearest_nm"] == 999.0 and alone[3]["min_tcpa_s"] == 9999.0


def test_candidates_are_ranked_in_their_row(spark, data):
    """The best candidates come from arrays, with no sort of candidates over tasks."""
    from skyledger.operators import policy as L
    from skyledger.operators import policy_queries as Q

    keys = ["tick", "trajectory_id"]
    want = L.best(L.with_margin(Q.scored(spark, data), keys), keys).select("event_id", "candidate_id", "score", "margin")
    found = L.first_choice(Q.ordered(spark, data)).select("event_id", "candidate_id", "score", "margin")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1


def test_ranker_of_equal_rows_counted_once(spark, data):
    """Rows that are alike are learnt from as one with their weights, with the scores that all rows give."""
    from skyledger.operators import more_queries as M

    rows = M.labelled_candidates(spark, data).where("event_id % 4 = 0").select(*M.FEATURES, *M.CATEGORIES, "label", "weight")
    rows = rows.unionByName(rows)
    few = M.alike(rows, rows.columns)
    assert few.agg({"n": "sum"}).first()[0] == rows.count() >= 2 * few.count()
    each = rows.distinct().limit(200)
    scores = [sorted(round(r.score, 6) for r in M.positive_score(model, each).collect()) for model in (M.fitted(rows, M.FEATURES, M.CATEGORIES), M.ranker(M.FEATURES, M.CATEGORIES).fit(rows))]
    assert scores[0] == scores[1]
