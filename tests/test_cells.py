"""Pairs found by cells are those among all pairs, at the date line, near the poles, and with speeds of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import cells
from skyledger.operators import pairs as P

SCHEMA = "tick long, trajectory_id long, lat double, lon double, alt_m double, gs_mps double, trk_deg double, vs_mps double"


def around(spark, lat, lon, n=90, fast=()):
    rng = np.random.default_rng(int(abs(lat * 10)) + 1)
    spread = 1.5 / max(np.cos(np.radians(min(abs(lat), 89.0))), 0.02)
    rows = []
    for k in range(n):
        place = float(np.clip(lat + rng.normal(0, 0.7), -90, 90)), float((lon + rng.normal(0, spread) + 180) % 360 - 180)
        speed = 1e6 if k in fast else float(rng.choice([0.0, 5.0, 80.0, 230.0]))
        rows.append((k % 2, k, *place, 9000.0 + 200 * (k % 4), speed, float(rng.uniform(0, 360)), float(k % 3 - 1)))
    rows += [(0, 900, None, lon, 1.0, 1.0, 1.0, 1.0), (0, 901, lat, None, 1.0, 1.0, 1.0, 1.0), (None, 902, lat, lon, 1.0, 1.0, 1.0, 1.0), (0, 903, lat, lon, 9000.0, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(map(tuple, df.select("tick", "id1", "id2").collect()))


def all_pairs(monkeypatch):
    """The same formulas over all pairs of a tick."""
    monkeypatch.setattr(P, "near_pairs", lambda states, *_, ordered=False, **__: P.pairs(states, ordered))


@pytest.mark.parametrize("lat, lon, fast", [(0.0, 179.9, ()), (80.0, 20.0, (3,)), (-89.9, 180.0, ()), (52.0, -179.95, (3,))])
def test_conflicts_and_contacts_equal_those_of_all_pairs(spark, monkeypatch, lat, lon, fast):
    states = around(spark, lat, lon, fast=fast)
    finders = (P.directed_conflicts, lambda s: P.directed_conflicts(s, radius="sum"), P.contacts, lambda s: P.approaches(s, 20.0), lambda s: P.pairs_within(s, 9.0), lambda s: P.pairs_within(s, 9.0, ordered=True))
    got = [ids(find(states)) for find in finders]
    all_pairs(monkeypatch)
    assert got == [ids(find(states)) for find in finders]
    assert got[0] and got[2]


@pytest.mark.parametrize("lat, lon", [(0.0, 179.9), (30.0, 104.0), (80.0, 20.0), (-89.9, 180.0)])
def test_no_pair_within_the_gate_is_missed_and_cells_spare_work(spark, lat, lon):
    states = around(spark, lat, lon, n=200).where("trajectory_id < 900")
    for gate in (0.5, 60.0, 20_000.0):
        away = geo.distance_nm(*[F.col(x) for x in ("lat1", "lon1", "lat2", "lon2")])
        want = ids(P.pairs(states).where(away <= gate))
        met = ids(cells.near_pairs(states, gate))
        assert set(want) <= set(met) and len(met) == len(set(met))
        if gate == 0.5:
            assert len(met) < 0.3 * P.pairs(states).count() or abs(lat) > 89


def test_head_on_over_the_date_line(spark):
    rows = [(0, 1, 0.0, 179.99, 9000.0, 200.0, 90.0, 0.0), (0, 2, 0.0, -179.99, 9000.0, 200.0, 270.0, 0.0)]
    states = spark.createDataFrame(rows, SCHEMA)
    assert ids(P.directed_conflicts(states)) == [(0, 1, 2), (0, 2, 1)] == ids(P.contacts(states))
    near = P.with_cpa(P.pairs_within(states, 6.0)).first()
    assert abs(near["now_nm"] - 1.2 * np.cos(np.radians(geo.CENTRE_LAT))) < 1e-9 and near["cpa_nm"] < 1e-6


def test_one_fast_aircraft_widens_only_its_own_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(0, k, float(rng.uniform(-60, 60)), float(rng.uniform(-180, 180)), 9000.0, 1e6 if k == 5 else 200.0, 0.0, 0.0) for k in range(600)]
    states = spark.createDataFrame(rows, SCHEMA)
    met = ids(cells.near_pairs(states, 5.0, P.flown_nm(300.0)))
    with_fast = [p for p in met if 5 in p[1:]]
    assert len(with_fast) == 599 and len(met) - len(with_fast) < 5_000


def test_no_states_make_no_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.directed_conflicts(none).count() == P.contacts(none).count() == P.approaches(none, 5.0).count() == P.pairs_within(none, 5.0).count() == 0


@pytest.mark.parametrize("lat, lon", [(0.0, 179.9), (52.0, 104.0)])
def test_traffic_features_equal_those_of_all_pairs(spark, lat, lon):
    states = around(spark, lat, lon, n=60, fast=(3,)).where("trajectory_id < 900")
    far = spark.createDataFrame([(0, 700, -lat, lon + 3 if lon < 170 else 0.0, 50.0, 100.0, 10.0, 0.0), (9, 701, lat, lon, 9000.0, 100.0, 0.0, 0.0)], SCHEMA)
    states = states.unionByName(far)
    p = P.with_cpa(P.pairs(states, ordered=True)).withColumn("gap", F.abs(F.col("alt1") - F.col("alt2")))
    want = p.groupBy("tick", "id1").agg(F.count("*").alias("n"), F.min("now_nm").alias("near"), F.min("gap").alias("gap"), F.min(F.struct("cpa_nm", "tcpa")).alias("cpa"))
    want = {(r["tick"], r["id1"]): (r["n"], r["near"], r["gap"], *r["cpa"]) for r in want.collect()} | {(9, 701): (0, 999.0, 99999.0, 999.0, 9999.0)}
    got = {(r["tick"], r["trajectory_id"]): tuple(r)[2:] for r in P.traffic_features(states).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert np.allclose(got[key], values, atol=1e-9), key


def test_cell_metrics_equal_those_of_all_pairs(spark):
    from skyledger.operators.sequence_queries import cell_metrics

    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 25)), float(rng.integers(0, 20)), float(rng.choice([100.0, 118.0, 118.01, 150.0])), float(rng.integers(0, 36) * 10), float(rng.choice([0.0, 2.54, 3.0, -5.0]))) for _ in range(300)]
    got = {(r["cell"], r["window"]): r for r in cell_metrics(spark.createDataFrame(rows, "cell long, trajectory_id long, t double, gs_mps double, trk_deg double, vs_mps double"), 5.0).collect()}
    groups: dict = {}
    for cell, who, t, *values in sorted(rows, key=lambda r: r[2:]):
        groups.setdefault((cell, int(t // 5)), {}).setdefault(who, []).append((t, values))
    assert got.keys() == groups.keys()
    for key, own in groups.items():
        first = [(v[0][1][0] * 3600 / 1852, v[0][1][1], np.sign(v[0][1][2]) * (abs(v[0][1][2]) * 60 / 0.3048 > 500)) for v in own.values()]
        stay = sum(v[-1][0] - v[0][0] for v in own.values()) / 5
        differ = [sum(1 for i, a in enumerate(first) for j, b in enumerate(first) if i != j and far(a, b)) for far in (
            lambda a, b: abs(a[0] - b[0]) > 35, lambda a, b: min(abs(a[1] - b[1]), 360 - abs(a[1] - b[1])) > 20, lambda a, b: a[2] != b[2])]
        r = got[key]
        assert (r["aircraft"], r["speed_pairs"], r["heading_pairs"], r["sense_pairs"]) == (len(own), *differ) and abs(r["occupancy"] - stay) < 1e-9
