"""Surveillance messages: published samples, wrong bits, and round trips."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyledger.sources import modes as M

#: Published sample messages: a name, an even and an odd position, a velocity over ground and one through the air.
NAME, EVEN, ODD, GROUND, AIR = (
    "8D4840D6202CC371C32CE0576098", "8D40621D58C382D690C8AC2863A7", "8D40621D58C386435CC412692AD6", "8D485020994409940838175B284F", "8DA05F219B06B6AF189400CBC33F",
)


def said(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r[0] for r in rows.select(M.fields(F.col("raw"))).collect()]


def test_published_messages(spark):
    name, even, odd, ground, air = said(spark, NAME, EVEN, ODD, GROUND, AIR)
    assert (name["df"], name["ca"], name["icao"], name["type_code"], name["name"], name["alt_ft"]) == (17, 5, "4840D6", 4, "KLM1023", None)
    assert (even["icao"], even["odd"], even["cpr_lat"], even["cpr_lon"], even["alt_ft"]) == ("40621D", 0, 93000, 51372, 38000)
    assert (odd["odd"], odd["cpr_lat"], odd["cpr_lon"]) == (1, 74158, 50194)
    v = ground["velocity"]
    assert abs(v["speed_kt"] - 159.2) < 0.01 and abs(v["track_deg"] - 182.88) < 0.01 and v["climb_fpm"] == -832
    v = air["velocity"]
    assert v["speed_kt"] == 375 and abs(v["track_deg"] - 243.98) < 0.01 and v["climb_fpm"] == -2304
    assert ground["name"] is None and ground["cpr_lat"] is None and name["velocity"]["speed_kt"] is None


def test_published_position(spark):
    (even, odd) = said(spark, EVEN, ODD)
    frames = [F.lit(x) for x in (even["cpr_lat"], even["cpr_lon"], odd["cpr_lat"], odd["cpr_lon"])]
    lat, lon = M.decoded(*frames)
    late, lone = M.decoded(*frames, F.lit(True))
    r = spark.range(1).select(lat, lon, late, lone).first()
    assert abs(r[0] - 52.2572) < 1e-4 and abs(r[1] - 3.91937) < 1e-4
    assert abs(r[2] - 52.26578) < 1e-4 and abs(r[3] - 3.93892) < 1e-3


def test_any_wrong_bit_is_refused(spark):
    flipped = [f"{int(EVEN, 16) ^ (1 << k):028X}" for k in range(112)]
    rows = spark.createDataFrame([(t,) for t in [EVEN, EVEN.lower(), *flipped, "", "8D", EVEN + "00", "zz" + EVEN[2:], None]], "raw string")
    ok = [r[0] for r in rows.select(M.well_formed(F.col("raw"))).collect()]
    assert ok == [True, True, *[False] * 112, False, False, False, False, None]
    assert said(spark, flipped[5], "", None) == [None] * 3


@pytest.mark.parametrize("lat, lon", [(30.5, 104.2), (-33.9, 151.2), (52.25, -179.99), (86.9, 10.0), (0.01, -0.01), (-88.0, 77.0)])
def test_positions_are_found_again_anywhere(spark, lat, lon):
    (y0, x0), (y1, x1) = (M.encoded(F.lit(lat), F.lit(lon), odd) for odd in (0, 1))
    r = spark.range(1).select(*M.decoded(y0, x0, y1, x1), *M.decoded(y0, x0, y1, x1, F.lit(True))).first()
    assert r[0] is not None and abs(r[0] - lat) < 1e-3 and abs((r[1] - lon + 180) % 360 - 180) < 2e-3 / max(0.05, abs(90 - abs(lat)) / 90)
    assert abs(r[2] - lat) < 1e-3


def test_built_messages_are_read_back(spark):
    rows = spark.range(40).select(
        M.message(F.col("id") + 0xABC000, F.lit(11), M.position_bits(F.col("id") * 25 - 1000, F.lit(1), F.col("id") * 3000, F.col("id") * 7)).alias("p"),
        M.message(F.col("id") + 0xABC000, F.lit(19), M.velocity_bits(F.col("id") * 20 - 400, 300 - F.col("id"), (F.col("id") - 20) * 64)).alias("v"),
        M.message(F.col("id") + 0xABC000, F.lit(4), M.name_bits(F.concat(F.lit("AB"), F.col("id").cast("string")))).alias("n"), "id",
    )
    for r in rows.select("id", *[M.fields(F.col(x)).alias(x) for x in "pvn"]).collect():
        k = r["id"]
        assert r["p"]["icao"] == f"{k + 0xABC000:06X}" and (r["p"]["alt_ft"], r["p"]["odd"], r["p"]["cpr_lat"], r["p"]["cpr_lon"]) == (k * 25 - 1000, 1, k * 3000, k * 7)
        assert abs(r["v"]["velocity"]["speed_kt"] - ((k * 20 - 400) ** 2 + (300 - k) ** 2) ** 0.5) < 1e-9 and r["v"]["velocity"]["climb_fpm"] == (k - 20) * 64
        assert r["n"]["name"] == f"AB{k}"
