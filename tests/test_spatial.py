"""Nearest points, group plans, speech and sinks against brute force and literal cases."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.functions import speech
from skyledger.operators import pairs as P
from skyledger.operators import resolve as R
from skyledger.operators import spatial
from skyledger.operators.more_queries import require
from skyledger.sources import sinks


@pytest.mark.parametrize("lat, lon", [(0.0, 10.0), (60.0, 10.0), (75.0, 179.8), (-88.0, -179.9)])
def test_nearest_points_at_any_place(spark, lat, lon):
    rng = np.random.default_rng(int(abs(lat)) + 1)
    place = lambda n, far: list(zip(range(n), np.clip(lat + rng.normal(0, far, n), -90, 90).tolist(), ((lon + rng.normal(0, 3 * far, n) + 180) % 360 - 180).tolist()))
    states, points = place(60, 1.0), place(25, 2.0)
    found = spatial.nearest_points(spark.createDataFrame(states, "event_id long, lat double, lon double"), spark.createDataFrame(points, "wpt long, wlat double, wlon double"))
    got = {r["event_id"]: r["wpt"] for r in found.collect()}

    def away(state, point):
        east = ((point[2] - state[2] + 180) % 360 - 180) * math.cos(math.radians(state[1]))
        return round(east**2 + (point[1] - state[1]) ** 2, 12), point[0]

    assert got == {s[0]: min(away(s, p) for p in points)[1] for s in states}


def test_points_on_the_other_side_of_the_earth(spark):
    states = spark.createDataFrame([(1, 50.0, 0.0), (2, None, 0.0)], "event_id long, lat double, lon double")
    points = spark.createDataFrame([(7, -50.0, 179.0), (8, -60.0, 180.0)], "wpt long, wlat double, wlon double")
    assert [tuple(r) for r in spatial.nearest_points(states, points).collect()] == [(1, 7)]
    assert spatial.nearest_points(states, points.limit(0)).count() == 0


def test_pairs_by_reach_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2, k, 30 + 6 * rng.random(), 118 + 6 * rng.random(), 9000.0, 180 + 80 * rng.random(), 360 * rng.random(), 0.0) for k in range(120)]
    states = spark.createDataFrame(rows, "tick long, trajectory_id long, lat double, lon double, alt_m double, gs_mps double, trk_deg double, vs_mps double")
    ids = lambda df: sorted(map(tuple, df.select("tick", "id1", "id2").collect()))
    assert ids(P.approaches(states, 20.0)) == ids(P.with_cpa(P.pairs(states)).where("cpa_nm < 20"))
    far = P.pairs_within(states, 1e6, ordered=True).count()
    assert far == P.pairs(states, ordered=True).count()


def test_group_plans_against_every_yielder(spark):
    rng = np.random.default_rng(5)
    place = {k: (30 + 0.05 * rng.random(), 104 + 0.05 * rng.random(), 9000 + 100 * rng.random(), 200 + 50 * rng.random(), 360 * rng.random()) for k in range(4)}
    rows = [(0, 0, i, j, *place[i], *place[j], 30.0) for i, j in itertools.combinations(range(4), 2)]
    side = lambda n: f"lat{n} double, lon{n} double, alt{n} double, gs{n} double, trk{n} double"
    pairs = spark.createDataFrame(rows, f"tick long, component long, id1 long, id2 long, {side(1)}, {side(2)}, lat0 double")
    got = {(r["who"], r["what"]): (r["losses"], round(r["min_km"], 9), round(r["min_ft"], 6)) for r in R.group_plans(pairs).collect()}
    each = [r.asDict() for r in R.template_scores(pairs).collect()]
    for who, what in [(-1, ""), *itertools.product(range(4), R.TEMPLATES)]:
        own = [r for r in each if (r["who"], r["what"]) == (who, what) or (r["who"] == -1 and who not in (r["id1"], r["id2"]))]
        want = (sum(r["losses"] for r in own), round(min(r["min_km"] for r in own), 9), round(min(r["min_ft"] for r in own), 6))
        assert got[who, what] == want and len({(r["id1"], r["id2"]) for r in own}) == 6


def test_a_group_that_takes_too_many_trials_is_not_called_unsolvable(monkeypatch):
    allowed = pd.DataFrame([(0, 0, a, b, [0, 1], [1, 0]) for a, b in [(1, 2), (2, 3), (3, 4)]], columns=["tick", "component", "id1", "id2", "a", "b"])
    assert R.solve(allowed).action.tolist() == [0, 1, 0, 1]
    monkeypatch.setattr(R, "NODE_CAP", 2)
    assert set(R.solve(allowed).action) == {R.UNDECIDED}


def test_speech(spark):
    said = ["国航幺两三 上到 九千", "收到 中联航四五六", "请中国国际八八八 联系进近再见吧好的", "谢谢", None]
    rows = speech.with_callsign(spark.createDataFrame([(k, t) for k, t in enumerate(said)], "n int, words string"), F.col("words"))
    found = rows.withColumn("score", speech.role_score()).orderBy("n").collect()
    assert [r["callsign"] for r in found] == ["CCA123", "CUA456", "CCA888", None, None]
    assert [r["score"] for r in found] == [3, -2 - 1 + 2, 2, 0, 0]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é\n", None), (1, None, 0.5)], "b int, a string, c double")
    assert sinks.write_jsonl(rows, str(tmp_path / "j")) == 2
    text = sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert text == ['{"a":"é\\n","b":2,"c":null}', '{"a":null,"b":1,"c":0.5}']
    sinks.append_rows(rows.select("b"), str(tmp_path / "d"))
    sinks.append_rows(rows.select("b", "a"), str(tmp_path / "d"))
    assert sorted((r["b"], r["a"], r["header"]) for r in sinks.read_rows(spark, str(tmp_path / "d")).fillna("").collect()) == [(1, "", "b"), (1, "", "b,a"), (2, "", "b"), (2, "é\n", "b,a")]


def test_missing_columns_are_named(spark):
    rows = spark.createDataFrame([(1,)], "a int")
    assert require(rows, ["a"]) is rows
    with pytest.raises(ValueError, match="b, c"):
        require(rows, ["a", "c", "b"])


def test_nearest_points_by_a_name_with_many_in_one_place(spark):
    rng = np.random.default_rng(4)
    points = [(k, k % 2, 30 + int(rng.integers(0, 12)) / 10, 103 + int(rng.integers(0, 12)) / 10) for k in range(400)]
    states = [(k, k % 3, 30 + rng.random(), 103 + rng.random()) for k in range(50)] + [(90, 0, 30.0, -179.0), (91, 1, 80.0, 181.0)]
    found = spatial.nearest_points(spark.createDataFrame(states, "event_id long, name long, lat double, lon double"), spark.createDataFrame(points, "wpt long, name long, wlat double, wlon double"), by=["name"], wrapped=False)
    away = lambda s, p: (round(((p[3] - s[3]) * math.cos(math.radians(s[2]))) ** 2 + (p[2] - s[2]) ** 2, 12), p[0])
    assert {r["event_id"]: r["wpt"] for r in found.collect()} == {s[0]: min(away(s, p) for p in points if p[1] == s[1])[1] for s in states if s[1] < 2}


def test_cells_of_points_are_as_narrow_as_points_are_dense(spark):
    points = spark.range(3000).select(F.col("id").alias("wpt"), (30 + F.col("id") * 29 % 1000 / 1000).alias("wlat"), (103 + F.col("id") * 31 % 1500 / 1000).alias("wlon"))
    assert spatial.WIDTHS[spatial.first_width(points, [], True)] < 0.25 and spatial.WIDTHS[spatial.first_width(points.limit(3), [], True)] > 1
