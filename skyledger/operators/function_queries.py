"""Registered queries of scalar functions: each applies a family of column expressions to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import aero, geo, text
from skyledger.plans import oracle as O
from skyledger.registry import query
from skyledger.sources import adapters as A
from skyledger.sources.tables import table

c = F.col
C2 = "103.75::DOUBLE"
_HERE = ("lat", "lon", "30.5::DOUBLE", C2)
here = lambda: (c("lat"), c("lon"), F.lit(30.5), F.lit(103.75))
r = lambda x, name, n=6: F.round(x, n).alias(name)


def _path(spark, folder):
    return A.track_path(spark, folder)


def path_sql(*columns: str) -> str:
    return O.with_views(f"SELECT event_id, {', '.join(columns)} FROM track_path", "track_path")


@query("geo_radius", path_sql(f"{O.r6(O.radius('lat'), 3)} AS radius_m", f"{O.r6('9.7803::DOUBLE * (1 + 0.001932::DOUBLE * pow(sin(radians(lat)), 2)) / sqrt(1 - 6.694e-3 * pow(sin(radians(lat)), 2))')} AS gravity"))
def geo_radius(spark, folder):
    return _path(spark, folder).select("event_id", r(geo.earth_radius(c("lat")), "radius_m", 3), r(geo.gravity(c("lat")), "gravity"))


@query("geo_qdrdist", path_sql(f"{O.r6(O.bearing(*_HERE), 5)} AS qdr", f"{O.r6(O.distance_nm(*_HERE), 5)} AS dist_nm", f"{O.r6(O.haversine_km(*_HERE), 5)} AS dist_km"))
def geo_qdrdist(spark, folder):
    return _path(spark, folder).select("event_id", r(geo.bearing(*here()), "qdr", 5), r(geo.distance_nm(*here()), "dist_nm", 5), r(geo.haversine_km(*here()), "dist_km", 5))


_ARC, _B = f"(25.0::DOUBLE * 1852.0::DOUBLE / {O.radius('lat')})", "radians(trk_deg)"
_LAT2 = f"asin(sin(radians(lat)) * cos({_ARC}) + cos(radians(lat)) * sin({_ARC}) * cos({_B}))"


@query("geo_qdrpos", path_sql(f"{O.r6(f'degrees({_LAT2})')} AS lat2", f"{O.r6(f'degrees(radians(lon) + atan2(sin({_B}) * sin({_ARC}) * cos(radians(lat)), cos({_ARC}) - sin(radians(lat)) * sin({_LAT2})))')} AS lon2",
    f"{O.r6(f'lat + 25.0::DOUBLE * cos({_B}) / 60')} AS flat_lat2", f"{O.r6(f'lon + 25.0::DOUBLE * sin({_B}) / greatest(60 * cos(radians(lat)), 0.01::DOUBLE)')} AS flat_lon2"))
def geo_qdrpos(spark, folder):
    lat, lon = geo.destination(c("lat"), c("lon"), c("trk_deg"), F.lit(25.0))
    flat_lat, flat_lon = geo.flat_destination(c("lat"), c("lon"), c("trk_deg"), F.lit(25.0))
    return _path(spark, folder).select("event_id", r(lat, "lat2"), r(lon, "lon2"), r(flat_lat, "flat_lat2"), r(flat_lon, "flat_lon2"))


_DX = f"(radians({C2} - lon) * cos(radians(lat + 30.5::DOUBLE) * 0.5))"


@query("geo_kwikdist", path_sql(f"{O.r6(f'6371000.0::DOUBLE * sqrt(pow(radians(30.5::DOUBLE - lat), 2) + {_DX} * {_DX}) / 1852.0::DOUBLE')} AS dist_nm", f"{O.r6(O.pmod(f'degrees(atan2({_DX}, radians(30.5::DOUBLE - lat)))'), 5)} AS qdr"))
def geo_kwikdist(spark, folder):
    return _path(spark, folder).select("event_id", r(geo.flat_distance_nm(*here()), "dist_nm"), r(geo.flat_bearing(*here()), "qdr", 5))


@query("geo_local_xy", path_sql(f"{O.r6('(lon - 120.96985) * 60 * cos(radians(30.92095))')} AS x_nm", f"{O.r6('(lat - 30.92095) * 60')} AS y_nm", f"{O.r6('gs_mps / 1852 * sin(radians(trk_deg))', 9)} AS vx", f"{O.r6('gs_mps / 1852 * cos(radians(trk_deg))', 9)} AS vy"))
def geo_local_xy(spark, folder):
    x, y = geo.local_xy_nm(c("lat"), c("lon"))
    vx, vy = geo.velocity_nm_s(c("trk_deg"), c("gs_mps"))
    return _path(spark, folder).select("event_id", r(x, "x_nm"), r(y, "y_nm"), r(vx, "vx", 9), r(vy, "vy", 9))


_Z = ("30.0::DOUBLE", "103.0::DOUBLE")
_D, _OFF = O.angle(*_Z, "lat", "lon"), f"radians({O.bearing(*_Z, 'lat', 'lon')} - {O.bearing(*_Z, '31.0::DOUBLE', '104.5::DOUBLE')})"


@query("track_along_cross", path_sql(f"{O.r6(f'6371.0::DOUBLE * atan2(sin({_D}) * cos({_OFF}), cos({_D}))', 5)} AS along_km", f"{O.r6(f'6371.0::DOUBLE * asin(sin({_D}) * sin({_OFF}))', 5)} AS cross_km"))
def track_along_cross(spark, folder):
    along, cross = geo.along_cross_km(F.lit(30.0), F.lit(103.0), F.lit(31.0), F.lit(104.5), c("lat"), c("lon"))
    return _path(spark, folder).select("event_id", r(along, "along_km", 5), r(cross, "cross_km", 5))


@query("angle_wrap", path_sql(f"{O.r6(O.wrap180('trk_deg * 3 - 500'))} AS to180", f"{O.r6(O.pmod('trk_deg - 400'))} AS compass", f"{O.r6('radians(' + O.wrap180('trk_deg * 3 - 500') + ')')} AS to_pi"))
def angle_wrap(spark, folder):
    w = geo.wrap180(c("trk_deg") * 3 - 500)
    return _path(spark, folder).select("event_id", r(w, "to180"), r(geo.compass(c("trk_deg") - 400), "compass"), r(F.radians(w), "to_pi"))


_RHO, _T = O.density("alt_m"), O.temperature("alt_m")
_P = f"({_RHO} * 287.05287::DOUBLE * {_T})"
_A = f"sqrt(1.4::DOUBLE * 287.05287::DOUBLE * {_T})"


@query("aero_atmos", path_sql(f"{O.r6(_T)} AS temp_k", f"{O.r6(_RHO)} AS rho", f"{O.r6(_P, 4)} AS p_pa", f"{O.r6(_A)} AS sound_mps"))
def aero_atmos(spark, folder):
    h = c("alt_m")
    return _path(spark, folder).select("event_id", r(aero.temperature(h), "temp_k"), r(aero.density(h), "rho"), r(aero.pressure(h), "p_pa", 4), r(aero.sound_speed(h), "sound_mps"))


_CAS = f"sqrt(7.0::DOUBLE * 101325.0::DOUBLE / 1.225::DOUBLE * (pow({_P} * (pow(1 + {_RHO} * gs_mps * gs_mps / (7.0::DOUBLE * {_P}), 3.5::DOUBLE) - 1) / 101325.0::DOUBLE + 1, 2.0::DOUBLE / 7.0::DOUBLE) - 1))"
_IMPACT = "(101325.0::DOUBLE * (pow(1 + 1.225::DOUBLE * 150.0::DOUBLE * 150.0::DOUBLE / (7.0::DOUBLE * 101325.0::DOUBLE), 3.5::DOUBLE) - 1))"


@query("aero_speed_conv", path_sql(f"{O.r6(f'gs_mps / {_A}')} AS mach", f"{O.r6(_CAS, 5)} AS cas", f"{O.r6(f'gs_mps * sqrt({_RHO} / 1.225::DOUBLE)', 5)} AS eas",
    f"{O.r6(f'sqrt(7.0::DOUBLE * {_P} / {_RHO} * (pow(1 + {_IMPACT} / {_P}, 2.0::DOUBLE / 7.0::DOUBLE) - 1))', 5)} AS tas_of_150", f"{O.r6(f'0.78::DOUBLE * {_A}', 5)} AS tas_of_m78"))
def aero_speed_conv(spark, folder):
    h, v = c("alt_m"), c("gs_mps")
    return _path(spark, folder).select(
        "event_id", r(aero.tas_to_mach(v, h), "mach"), r(aero.tas_to_cas(v, h), "cas", 5), r(aero.tas_to_eas(v, h), "eas", 5),
        r(aero.cas_or_mach_to_tas(F.lit(150.0), h), "tas_of_150", 5), r(aero.cas_or_mach_to_tas(F.lit(0.78), h), "tas_of_m78", 5),
    )


@query("aero_units", path_sql("CAST(round_even(alt_m / 0.3048::DOUBLE, 0) AS BIGINT) AS feet", "CAST(round_even(gs_mps / 0.514444::DOUBLE, 0) AS BIGINT) AS knots"))
def aero_units(spark, folder):
    return _path(spark, folder).select("event_id", aero.feet_rounded(c("alt_m")).alias("feet"), aero.knots_rounded(c("gs_mps")).alias("knots"))


_PH = "SELECT *, vs_mps * 500 AS roc, CAST(event_id * 7 % 12000 AS DOUBLE) AS ft FROM track_path"
_PHASE = """CASE WHEN roc BETWEEN -4000 AND -150 AND ft <= 1000 AND ft >= 75 THEN 6 WHEN roc BETWEEN -4000 AND -150 AND ft >= 1000 THEN 5 WHEN roc BETWEEN -150 AND 150 AND ft >= 5000 THEN 4
    WHEN roc >= 150 AND ft >= 1000 THEN 3 WHEN roc >= 150 AND ft BETWEEN 75 AND 1000 THEN 2 WHEN ft <= 75 THEN 1 ELSE 0 END"""


@query("flight_phase", O.with_views(f"SELECT event_id, {_PHASE} AS phase, CASE {_PHASE} WHEN 1 THEN 15.0::DOUBLE WHEN 0 THEN 0.0::DOUBLE ELSE 35.0::DOUBLE END AS bank_deg FROM ph", "track_path", ph=_PH))
def flight_phase(spark, folder):
    p = _path(spark, folder).select("event_id", aero.flight_phase(c("gs_mps") / 0.514444, c("vs_mps") * 500, (c("event_id") * 7 % 12000).cast("double")).alias("phase"))
    return p.withColumn("bank_deg", aero.bank_limit(c("phase")))


_QS = f"(0.5::DOUBLE * {_RHO} * gs_mps * gs_mps * 122.6::DOUBLE)"


@query("perf_drag", path_sql(f"{O.r6(f'{_QS} * (0.02::DOUBLE + 0.04::DOUBLE * pow((60000.0::DOUBLE * 9.80665::DOUBLE / cos(radians(25.0::DOUBLE))) / greatest({_QS}, 1.0::DOUBLE), 2))', 2)} AS drag_n"))
def perf_drag(spark, folder):
    d = aero.drag_newton(c("gs_mps"), c("alt_m"), F.lit(60000.0), F.lit(122.6), F.lit(0.02), F.lit(0.04), F.lit(25.0))
    return _path(spark, folder).select("event_id", r(d, "drag_n", 2))


_FIT = """SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS x, pow(0.07, 2) + pow(0.3, 2) + pow(0.85, 2) + 1 AS s2, pow(0.07, 3) + pow(0.3, 3) + pow(0.85, 3) + 1 AS s3,
    pow(0.07, 4) + pow(0.3, 4) + pow(0.85, 4) + 1 AS s4, 0.07 * 0.1 + 0.3 * 0.3 + 0.85 * 0.9 + 1.1::DOUBLE AS sy, 0.07 * 0.07 * 0.1 + 0.3 * 0.3 * 0.3 + 0.85 * 0.85 * 0.9 + 1.1::DOUBLE AS s2y FROM track_path"""


@query("perf_fuel_flow", O.with_views(f"SELECT event_id, {O.r6('(s2 * s2y - s3 * sy) / (s2 * s4 - s3 * s3) * x * x + (s4 * sy - s3 * s2y) / (s2 * s4 - s3 * s3) * x')} AS kg_s FROM fit", "track_path", fit=_FIT))
def perf_fuel_flow(spark, folder):
    """Fuel flow of a fitted engine at each report's thrust ratio."""
    flow = aero.fuel_flow_kg_s((c("event_id") % 101).cast("double") / 100, F.lit(0.1), F.lit(0.3), F.lit(0.9), F.lit(1.1))
    return _path(spark, folder).select("event_id", r(flow, "kg_s"))


@query("normalise_state", path_sql(f"{O.r6('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (lat - 30.5) / 0.4))')} AS lat_n", f"{O.r6('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (lon - 103.75) / 0.6))')} AS lon_n", f"{O.r6('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (alt_m - 9800) / 1500))')} AS alt_n"))
def normalise_state(spark, folder):
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return _path(spark, folder).select("event_id", r(clip((c("lat") - 30.5) / 0.4), "lat_n"), r(clip((c("lon") - 103.75) / 0.6), "lon_n"), r(clip((c("alt_m") - 9800) / 1500), "alt_n"))


# -- text -----------------------------------------------------------------------------------------------------------


@query("callsign_normalise", """SELECT p_partkey, CASE WHEN regexp_full_match(b, '[A-Z0-9]{2,8}') AND regexp_matches(b, '[A-Z]') AND regexp_matches(b, '[0-9]') THEN b END AS callsign
    FROM (SELECT p_partkey, upper(regexp_replace(p_brand || '-' || CAST(p_size AS VARCHAR), '[^A-Za-z0-9]', '', 'g')) AS b FROM part)""")
def callsign_normalise(spark, folder):
    value = F.concat("p_brand", F.lit("-"), c("p_size").cast("string"))
    return table(spark, folder, "part").select("p_partkey", text.callsign(value).alias("callsign"))


@query("spoken_digits", """SELECT p_partkey, CASE WHEN length(d) BETWEEN 2 AND 6 THEN d END AS digits FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR) AS d FROM part)""")
def spoken_digits(spark, folder):
    spoken = F.translate(F.concat(c("p_partkey").cast("string"), F.lit(" "), c("p_size").cast("string")), "0123456789", "洞幺两三四五六拐八九")
    return table(spark, folder, "part").select("p_partkey", text.spoken_digits(spoken).alias("digits"))


@query("parse_command", O.with_views("SELECT event_id, family, callsign, target, unit, CASE WHEN family = 'altitude' THEN 'climb' ELSE 'set_speed' END AS action FROM sys", "sys"))
def parse_command(spark, folder):
    s = A.system_commands(spark, folder)
    return s.select("event_id", text.parsed_command(c("command")).alias("p")).select("event_id", "p.family", "p.callsign", "p.target", "p.unit", "p.action")


@query("format_command", O.with_views("""SELECT event_id, CASE WHEN family = 'altitude' THEN 'ALT_' ELSE 'SPD_' END || CAST(CAST(target AS BIGINT) AS VARCHAR) AS candidate,
    CASE WHEN family = 'altitude' THEN 'ALT_M ' || callsign || ',' || CAST(CAST(target AS BIGINT) AS VARCHAR) || ',CLIMB' ELSE 'SPD ' || callsign || ',' || CAST(CAST(target AS BIGINT) AS VARCHAR) END AS command FROM refs""", "refs"))
def format_command(spark, folder):
    f = A.references(spark, folder)
    return f.select("event_id", text.candidate_name(c("family"), c("target")).alias("candidate"), text.command_text(c("callsign"), c("family"), c("target"), F.lit("climb")).alias("command"))


@query("target_match", O.with_views("""SELECT r.event_id AS ref_id, s.event_id AS sys_id, CASE WHEN r.family = 'altitude' THEN abs(r.target - s.target) <= 100 ELSE abs(r.target - s.target) <= 10 END AS matched
    FROM refs r JOIN sys s ON r.callsign = s.callsign AND r.family = s.family AND abs(r.epoch - s.epoch) <= 3600""", "refs", "sys"))
def target_match(spark, folder):
    ref = A.references(spark, folder).select("callsign", "family", c("event_id").alias("ref_id"), c("target").alias("a"), c("unit").alias("u"), c("epoch").alias("t"), F.floor(c("epoch") / 3600).alias("h"))
    own = A.system_commands(spark, folder).select("callsign", "family", c("event_id").alias("sys_id"), c("target").alias("b"), c("unit").alias("w"), c("epoch").alias("s"), F.floor(c("epoch") / 3600).alias("k"))
    own = own.withColumn("h", F.explode(F.array(c("k") - 1, c("k"), c("k") + 1)))
    return ref.join(own, ["callsign", "family", "h"]).where(F.abs(c("t") - c("s")) <= 3600).select(
        "ref_id", "sys_id", text.target_match(c("family"), c("a"), c("u"), c("b"), c("w")).alias("matched")
    )


@query("plan_level", """SELECT p_partkey, CAST(p_size AS DOUBLE) * 100 AS level_m, CAST(CASE WHEN p_partkey % 3 = 0 THEN (400 + p_size) / 1.852::DOUBLE WHEN p_partkey % 3 = 1 THEN 400 + p_size END AS DOUBLE) AS speed_kt FROM part""")
def plan_level(spark, folder):
    k = c("p_partkey") % 3
    level = F.concat(F.lit("S"), F.lpad((c("p_size") * 10).cast("string"), 4, "0"))
    speed = F.concat(F.when(k == 0, "K0").when(k == 1, "N0").otherwise("X"), (c("p_size") + 400).cast("string"))
    return table(spark, folder, "part").select("p_partkey", text.metric_level(level).alias("level_m"), text.planned_speed_kt(speed).alias("speed_kt"))


@query("text_altitude", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) * 100 WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE -1e9 END AS feet, CAST(p_size * 3600 + p_partkey % 60 * 60 AS DOUBLE) + 7.5 AS seconds FROM part""")
def text_altitude(spark, folder):
    size, key = c("p_size").cast("string"), c("p_partkey") % 3
    level = F.when(key == 0, F.concat(F.lit("FL"), size)).when(key == 1, size).otherwise("high")
    clock = F.concat_ws(":", size, (c("p_partkey") % 60).cast("string"), F.lit("07.50"))
    return table(spark, folder, "part").select("p_partkey", text.altitude_ft(level).alias("feet"), text.clock_seconds(clock).alias("seconds"))


@query("text_lat", """SELECT p_partkey, round((CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END) * (p_size + (p_partkey % 60) / 60.0::DOUBLE + 30.0::DOUBLE / 3600), 9) AS degrees FROM part""")
def text_lat(spark, folder):
    t = F.concat(F.when(c("p_partkey") % 2 == 0, "S").otherwise("N"), c("p_size").cast("string"), F.lit("'"), (c("p_partkey") % 60).cast("string"), F.lit("'30"))
    return table(spark, folder, "part").select("p_partkey", F.round(text.coordinate(t), 9).alias("degrees"))


@query("intent_family", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'altitude' WHEN 1 THEN 'speed' WHEN 2 THEN 'heading' WHEN 3 THEN 'altitude' END AS family FROM part""")
def intent_family(spark, folder):
    names = F.array(*map(F.lit, [" Altitude_Change", "speed_adjust", "COURSE", "level", "other"]))
    return table(spark, folder, "part").select("p_partkey", text.family(F.get(names, (c("p_partkey") % 5).cast("int"))).alias("family"))


@query("event_epoch", f"SELECT event_id, {O.SECONDS} AS epoch FROM events")
def event_epoch(spark, folder):
    """ISO text back to seconds; every third time comes without a zone."""
    t = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    t = F.when(c("event_id") % 3 == 0, t).otherwise(F.concat(t, F.lit("Z")))
    return table(spark, folder, "events").select("event_id", text.iso_epoch(t).alias("epoch"))


@query("finite_or_null", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice END AS value FROM part")
def finite_or_null(spark, folder):
    k = c("p_partkey") % 4
    t = F.when(k == 0, c("p_retailprice").cast("string")).when(k == 1, "NaN").when(k == 2, "Infinity").otherwise("n/a")
    return table(spark, folder, "part").select("p_partkey", text.finite(t).alias("value"))


@query("missing_category", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE 'MISSING' END AS brand FROM part")
def missing_category(spark, folder):
    k = c("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(k == 1, "  ")
    return table(spark, folder, "part").select("p_partkey", text.or_missing(t).alias("brand"))


AIRPORTS = ("ZSSS", "ZSPD")
_PLACES = ("ZSSS", "ZBAA", "ZSPD", "ZGGG", "ZUUU")


@query("vertical_phase", O.with_views("SELECT event_id, CASE WHEN vs_mps > 0.5 THEN 'climbing' WHEN vs_mps < -0.5 THEN 'descending' ELSE 'level' END AS vertical FROM track_path", "track_path"))
def vertical_phase(spark, folder):
    return _path(spark, folder).select("event_id", text.vertical_phase(c("vs_mps")).alias("vertical"))


@query("phase_of_flight", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 IN (0, 2) THEN 'departure' WHEN l_partkey % 5 IN (0, 2) AND l_partkey % 7 <> 0 THEN 'arrival' ELSE 'overflight' END AS phase FROM lineitem""")
def phase_of_flight(spark, folder):
    """The phase of flights whose airports are known by name, in any case, or not at all."""
    place = lambda key: F.get(F.array(*map(F.lit, _PLACES)), (key % 5).cast("int"))
    ades = F.when(c("l_partkey") % 7 != 0, F.lower(place(c("l_partkey"))))
    adep = F.concat(F.lit(" "), place(c("l_suppkey")), F.lit(" "))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", text.phase_of_flight(adep, ades, AIRPORTS).alias("phase"))


@query("text_lon", """SELECT p_partkey, round((CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END) * (100 + p_size + (p_partkey % 60) / 60.0::DOUBLE + 15.5::DOUBLE / 3600), 9) AS degrees FROM part""")
def text_lon(spark, folder):
    """Longitudes with the letter in front or behind."""
    west = c("p_partkey") % 2 == 0
    t = F.concat_ws("'", (100 + c("p_size")).cast("string"), (c("p_partkey") % 60).cast("string"), F.lit("15.5"))
    t = F.when(c("p_partkey") % 3 == 0, F.concat(t, F.when(west, "W").otherwise("E"))).otherwise(F.concat(F.when(west, "W").otherwise("E"), t))
    return table(spark, folder, "part").select("p_partkey", F.round(text.coordinate(t), 9).alias("degrees"))


def _sql_tas_of_cas(cas: str) -> str:
    impact = f"(101325.0::DOUBLE * (pow(1 + 1.225::DOUBLE * {cas} * {cas} / (7.0::DOUBLE * 101325.0::DOUBLE), 3.5::DOUBLE) - 1))"
    return f"(sign({cas}) * sqrt(7.0::DOUBLE * {_P} / {_RHO} * (pow(1 + {impact} / {_P}, 2.0::DOUBLE / 7.0::DOUBLE) - 1)))"


@query("text_speed", path_sql(f"round(CASE event_id % 5 WHEN 0 THEN 0.78::DOUBLE * {_A} WHEN 1 THEN 0.8::DOUBLE * {_A} WHEN 2 THEN 0.6::DOUBLE * {_A} WHEN 3 THEN {_sql_tas_of_cas('(CAST(200 + event_id % 100 AS DOUBLE) * 0.514444::DOUBLE)')} ELSE -1 END, 5) AS tas_mps"))
def text_speed(spark, folder):
    """Speeds as texts, Mach numbers in three ways, knots, and one that is none."""
    k = c("event_id") % 5
    t = F.when(k == 0, "M78").when(k == 1, "M.8").when(k == 2, ".6").when(k == 3, (200 + c("event_id") % 100).cast("string")).otherwise("FAST")
    return _path(spark, folder).select("event_id", r(text.speed_mps(t, c("alt_m")), "tas_mps", 5))


_ENV = "50.0::DOUBLE + k AS vminto, 60.0::DOUBLE + k AS vminic, 70.0::DOUBLE + k AS vminer, 65.0::DOUBLE + k AS vminap, 100.0::DOUBLE + k AS vmaxic, 120.0::DOUBLE + k AS vmaxer, 90.0::DOUBLE + k AS vmaxap, -1.5::DOUBLE AS vsmin, 1.5::DOUBLE AS vsmax, 9000.0::DOUBLE + 500 * k AS hmax, 2.0::DOUBLE AS axmax"
_LIMITS = {
    "env": f"SELECT k, {_ENV} FROM (SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region)",
    "q0": "SELECT t.*, e.*, event_id % 7 AS phase, least(alt_m, hmax) AS hh FROM track_path t JOIN env e ON e.k = event_id % 5",
    "q1": "SELECT * REPLACE (hh AS alt_m) FROM q0",
    "q2": f"SELECT *, {_CAS} AS asked FROM q1",
    "q3": """SELECT *, least(greatest(asked, CASE phase WHEN 2 THEN vminic WHEN 3 THEN vminer WHEN 4 THEN vminer WHEN 5 THEN vminer WHEN 6 THEN vminap ELSE 0 END),
        CASE phase WHEN 1 THEN vmaxic WHEN 2 THEN vmaxic WHEN 6 THEN vmaxap ELSE vmaxer END) AS cas FROM q2""",
}


@query("phase_limit_check", O.with_views(f"""SELECT event_id, round({_sql_tas_of_cas('cas')}, 5) AS tas_mps, CASE WHEN phase = 1 AND gs_mps < vminto THEN 0 WHEN abs(vs_mps) > 1.5 THEN (1 - event_id % 3 / axmax) * vsmax ELSE vs_mps END AS vs_mps, alt_m AS h_m FROM q3""", "track_path", **_LIMITS))
def phase_limit_check(spark, folder):
    """Speed, rate and height that are asked for, held to the envelope of the type and the phase; types are a small dimension."""
    k = c("r_regionkey").cast("double")
    values = {"vminto": 50 + k, "vminic": 60 + k, "vminer": 70 + k, "vminap": 65 + k, "vmaxic": 100 + k, "vmaxer": 120 + k, "vmaxap": 90 + k, "vsmin": F.lit(-1.5), "vsmax": F.lit(1.5), "hmax": 9000 + 500 * k, "axmax": F.lit(2.0)}
    types = table(spark, folder, "region").select(c("r_regionkey").cast("long").alias("type"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("envelope"))
    t = _path(spark, folder).withColumn("type", c("event_id") % 5).join(types, "type")
    ax = (c("event_id") % 3).cast("double")
    held = aero.within_envelope(c("gs_mps"), c("vs_mps"), c("alt_m"), ax, c("gs_mps"), c("event_id") % 7, c("envelope"))
    return t.select("event_id", held.alias("x")).select("event_id", r(c("x.tas"), "tas_mps", 5), c("x.vs").alias("vs_mps"), c("x.h").alias("h_m"))


@query("perf_thrust", O.with_views(f"""SELECT event_id, round(q, 3) AS drag_n, round(q + 60000.0::DOUBLE * (event_id % 5) / 10, 3) AS thrust_n FROM (SELECT event_id, alt_m, qs * (0.02::DOUBLE + 0.04::DOUBLE * pow(60000.0::DOUBLE * 9.80665::DOUBLE / greatest(qs, 1.0::DOUBLE), 2)) AS q
    FROM (SELECT event_id, alt_m, 0.5::DOUBLE * {O.density('alt_m')} * gs_mps * gs_mps * 120 AS qs FROM track_path))""", "track_path"))
def perf_thrust(spark, folder):
    """Net thrust in level flight, speeding up by up to 0.4 m/s2."""
    drag = aero.drag_newton(c("gs_mps"), c("alt_m"), F.lit(60_000.0), F.lit(120.0), F.lit(0.02), F.lit(0.04), F.lit(0.0))
    thrust = aero.net_thrust_newton(drag, F.lit(60_000.0), (c("event_id") % 5) / 10)
    return _path(spark, folder).select("event_id", r(drag, "drag_n", 3), r(thrust, "thrust_n", 3))
