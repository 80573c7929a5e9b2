"""Registered queries of window and sequence operators over trajectories, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import spatial
from skyledger.plans import oracle as O
from skyledger.registry import query
from skyledger.sources import adapters as A
from skyledger.sources.tables import table

c = F.col
BY_TIME = ("t", "event_id")
ORDER = "OVER (PARTITION BY trajectory_id ORDER BY t, event_id)"


def along(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("trajectory_id",))).orderBy(*BY_TIME)


def runs(df: DataFrame, keys: list[str], order: list, starts: Column) -> DataFrame:
    """``df`` with ``run``: numbers of stretches, a new one wherever ``starts`` holds."""
    return df.withColumn("run", F.sum(F.coalesce(starts.cast("long"), F.lit(1))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def path(body: str, **own: str) -> str:
    return O.with_views(body, "track_path", **own)


@query("latest_per_key", O.with_views("SELECT trajectory_id, tick, event_id FROM tracks", "tracks"))
def latest_per_key(spark, folder):
    return A.tracks(spark, folder).select("trajectory_id", "tick", "event_id")


STEP = f"coalesce(t - lag(t) {ORDER}, 0)"


@query("cumulative_distance", path("SELECT event_id, round(sum(d) OVER (PARTITION BY trajectory_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) AS flown_m FROM s", s=f"SELECT *, gs_mps * {STEP} AS d FROM track_path"))
def cumulative_distance(spark, folder):
    step = c("gs_mps") * F.coalesce(c("t") - F.lag("t").over(along()), F.lit(0.0))
    p = A.track_path(spark, folder).withColumn("d", step)
    return p.select("event_id", F.round(F.sum("d").over(along().rowsBetween(Window.unboundedPreceding, 0)), 3).alias("flown_m"))


@query("flight_statistics", path("""SELECT trajectory_id, round(max(t) - min(t), 6) AS flight_s, round(sum(dt * gs_mps), 3) AS dist2d_m, round(sum(dt * sqrt(gs_mps * gs_mps + vs_mps * vs_mps)), 3) AS dist3d_m, round(sum(60000.0::DOUBLE * dt * gs_mps) / 1e9, 6) AS work_gj FROM s GROUP BY 1""", s=f"SELECT *, {STEP} AS dt FROM track_path"))
def flight_statistics(spark, folder):
    p = A.track_path(spark, folder).withColumn("dt", F.coalesce(c("t") - F.lag("t").over(along()), F.lit(0.0)))
    space = F.sqrt(c("gs_mps") ** 2 + c("vs_mps") ** 2)
    return p.groupBy("trajectory_id").agg(
        F.round(F.max("t") - F.min("t"), 6).alias("flight_s"), F.round(F.sum(c("dt") * c("gs_mps")), 3).alias("dist2d_m"),
        F.round(F.sum(c("dt") * space), 3).alias("dist3d_m"), F.round(F.sum(60000.0 * c("dt") * c("gs_mps")) / 1e9, 6).alias("work_gj"),
    )


@query("leg_geometry", path(f"SELECT event_id, round(coalesce(q, lag(q) {ORDER}), 5) AS course, round(coalesce(d, 0), 5) AS dist_nm FROM s",
    n=f"SELECT *, lead(lat) {ORDER} AS lat2, lead(lon) {ORDER} AS lon2 FROM track_path", s=f"SELECT *, {O.bearing('lat', 'lon', 'lat2', 'lon2')} AS q, {O.distance_nm('lat', 'lon', 'lat2', 'lon2')} AS d FROM n"))
def leg_geometry(spark, folder):
    """Course and length to the next point; the last point keeps the last course."""
    p = A.track_path(spark, folder).withColumns({"lat2": F.lead("lat").over(along()), "lon2": F.lead("lon").over(along())})
    ends = (c("lat"), c("lon"), c("lat2"), c("lon2"))
    p = p.withColumns({"q": geo.bearing(*ends), "d": geo.distance_nm(*ends)})
    return p.select("event_id", F.round(F.coalesce("q", F.lag("q").over(along())), 5).alias("course"), F.round(F.coalesce("d", F.lit(0.0)), 5).alias("dist_nm"))


_NEXT = "first_value(CASE WHEN event_id % 4 = 0 THEN {} END IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("next_constraint", path(f"SELECT event_id, {_NEXT.format('event_id')} AS constraint_id, round({_NEXT.format('t')} - t, 6) AS seconds_to, {_NEXT.format('alt_m')} AS constraint_m FROM track_path"))
def next_constraint(spark, folder):
    """The next point, itself included, with an altitude constraint (every fourth report has one), and the time to it."""
    own = F.when(c("event_id") % 4 == 0, F.struct("event_id", "t", "alt_m"))
    p = A.track_path(spark, folder).withColumn("n", F.first(own, ignorenulls=True).over(along().rowsBetween(0, Window.unboundedFollowing)))
    return p.select("event_id", c("n.event_id").alias("constraint_id"), F.round(c("n.t") - c("t"), 6).alias("seconds_to"), c("n.alt_m").alias("constraint_m"))


@query("turn_anticipation", path(f"SELECT event_id, round(gs_mps * gs_mps / (9.80665::DOUBLE * tan(radians(25.0::DOUBLE))), 3) AS radius_m, round(gs_mps * gs_mps / (9.80665::DOUBLE * tan(radians(25.0::DOUBLE))) * abs(tan(radians({O.wrap180('nxt - trk_deg')} / 2))), 2) AS lead_m FROM s WHERE abs({O.wrap180('nxt - trk_deg')}) < 170",
    s=f"SELECT *, lead(trk_deg) {ORDER} AS nxt FROM track_path"))
def turn_anticipation(spark, folder):
    """Turn radius at 25 degrees of bank, and how far before the waypoint the turn begins."""
    p = A.track_path(spark, folder).withColumn("turn", geo.wrap180(F.lead("trk_deg").over(along()) - c("trk_deg"))).where(F.abs("turn") < 170)
    radius = c("gs_mps") ** 2 / (9.80665 * F.tan(F.radians(F.lit(25.0))))
    return p.select("event_id", F.round(radius, 3).alias("radius_m"), F.round(radius * F.abs(F.tan(F.radians(c("turn") / 2))), 2).alias("lead_m"))


@query("sector_transitions", path("SELECT tick, count_if(inside AND NOT coalesce(was, false)) AS arrived, count_if(NOT inside AND coalesce(was, false)) AS departed FROM s GROUP BY tick", s=f"SELECT *, lag(inside) {ORDER} AS was FROM track_path"))
def sector_transitions(spark, folder):
    p = A.track_path(spark, folder).withColumn("was", F.lag("inside").over(along()))
    return p.groupBy("tick").agg(F.count_if(c("inside") & ~F.coalesce("was", F.lit(False))).alias("arrived"), F.count_if(~c("inside") & c("was")).alias("departed"))


@query("area_exit_events", path("SELECT event_id, trajectory_id FROM s WHERE was AND NOT inside", s=f"SELECT *, lag(inside) {ORDER} AS was FROM track_path"))
def area_exit_events(spark, folder):
    p = A.track_path(spark, folder).withColumn("was", F.lag("inside").over(along()))
    return p.where("was and not inside").select("event_id", "trajectory_id")


_RUN = "SELECT *, sum(CASE WHEN was IS NULL OR was <> inside THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s"


@query("stay_sessions", path("SELECT trajectory_id, run, round(min(t), 6) AS entered, round(max(t), 6) AS last_seen, count(*) AS reports, round(sum(gs_mps * dt), 3) AS flown_m FROM r WHERE inside GROUP BY ALL",
    s=f"SELECT *, lag(inside) {ORDER} AS was, {STEP} AS dt FROM track_path", r=_RUN))
def stay_sessions(spark, folder):
    """Stays in the sector: stretches of reports inside it, with when, how many and how far."""
    p = A.track_path(spark, folder).withColumns({"was": F.lag("inside").over(along()), "dt": F.coalesce(c("t") - F.lag("t").over(along()), F.lit(0.0))})
    p = runs(p, ["trajectory_id"], list(BY_TIME), c("was") != c("inside")).where("inside")
    return p.groupBy("trajectory_id", "run").agg(
        F.round(F.min("t"), 6).alias("entered"), F.round(F.max("t"), 6).alias("last_seen"), F.count("*").alias("reports"), F.round(F.sum(c("gs_mps") * c("dt")), 3).alias("flown_m")
    )


@query("sector_efficiency", path(f"SELECT trajectory_id, run, round(flown / direct, 5) AS efficiency FROM (SELECT trajectory_id, run, flown, {O.distance_nm('la1', 'lo1', 'la2', 'lo2')} AS direct FROM g) WHERE direct > 10",
    s=f"SELECT *, lag(inside) {ORDER} AS was, {STEP} AS dt FROM track_path", r=_RUN,
    g="SELECT trajectory_id, run, sum(gs_mps * dt) / 1852 AS flown, arg_min(lat, t) AS la1, arg_min(lon, t) AS lo1, arg_max(lat, t) AS la2, arg_max(lon, t) AS lo2 FROM r WHERE inside GROUP BY ALL"))
def sector_efficiency(spark, folder):
    """Distance flown in a stay over the great-circle distance from entry to exit, for stays over 10 NM."""
    p = A.track_path(spark, folder).withColumns({"was": F.lag("inside").over(along()), "dt": F.coalesce(c("t") - F.lag("t").over(along()), F.lit(0.0))})
    g = runs(p, ["trajectory_id"], list(BY_TIME), c("was") != c("inside")).where("inside").groupBy("trajectory_id", "run").agg(
        (F.sum(c("gs_mps") * c("dt")) / 1852).alias("flown"), F.min_by(F.struct("lat", "lon"), "t").alias("a"), F.max_by(F.struct("lat", "lon"), "t").alias("b")
    )
    direct = geo.distance_nm(c("a.lat"), c("a.lon"), c("b.lat"), c("b.lon"))
    return g.withColumn("direct", direct).where("direct > 10").select("trajectory_id", "run", F.round(c("flown") / c("direct"), 5).alias("efficiency"))


@query("crossing_trigger", path("SELECT trajectory_id, min_by(event_id, (t, event_id)) AS fired_at FROM s WHERE was IS NOT NULL AND was * diff <= 0 GROUP BY 1".replace("min_by(event_id, (t, event_id))", "arg_min(event_id, t)"),
    d="SELECT *, alt_m - 9950.0::DOUBLE AS diff FROM track_path", s=f"SELECT *, lag(diff) {ORDER} AS was FROM d"))
def crossing_trigger(spark, folder):
    """Once per aircraft: the report at which its altitude first crosses a target."""
    p = A.track_path(spark, folder).withColumn("diff", c("alt_m") - 9950.0)
    p = p.withColumn("was", F.lag("diff").over(along())).where("was * diff <= 0")
    return p.groupBy("trajectory_id").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("fired_at"))


@query("downsample_every_k", path("SELECT event_id FROM s WHERE n % 5 = 0", s=f"SELECT event_id, row_number() {ORDER} AS n FROM track_path"))
def downsample_every_k(spark, folder):
    return A.track_path(spark, folder).withColumn("n", F.row_number().over(along())).where("n % 5 = 0").select("event_id")


@query("trail_segments", path("SELECT event_id, round(lat0, 6) AS lat0, round(lon0, 6) AS lon0, round(lat, 6) AS lat1, round(lon, 6) AS lon1 FROM s WHERE lat0 IS NOT NULL",
    k="SELECT * FROM track_path QUALIFY row_number() OVER (PARTITION BY trajectory_id, tick ORDER BY t, event_id) = 1", s=f"SELECT *, lag(lat) {ORDER} AS lat0, lag(lon) {ORDER} AS lon0 FROM k"))
def trail_segments(spark, folder):
    """Line pieces between the first points of successive ticks."""
    first = F.row_number().over(along("trajectory_id", "tick"))
    k = A.track_path(spark, folder).withColumn("n", first).where("n = 1")
    k = k.withColumns({"lat0": F.lag("lat").over(along()), "lon0": F.lag("lon").over(along())}).where("lat0 is not null")
    return k.select("event_id", F.round("lat0", 6).alias("lat0"), F.round("lon0", 6).alias("lon0"), F.round("lat", 6).alias("lat1"), F.round("lon", 6).alias("lon1"))


_SPAN = "SELECT trajectory_id, CAST(event_id * 7 % 360 AS DOUBLE) AS a, CAST(event_id * 7 % 360 + event_id % 23 AS DOUBLE) AS b, event_id FROM track_path"


@query("interval_merge", path("SELECT trajectory_id, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY trajectory_id, island", i=_SPAN,
    m="SELECT *, max(b) OVER (PARTITION BY trajectory_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i",
    g="SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m").replace("GROUP BY trajectory_id, island", "GROUP BY trajectory_id, island"))
def interval_merge(spark, folder):
    """The union of an aircraft's intervals as intervals that do not touch."""
    i, e = A.track_path(spark, folder), c("event_id")
    i = i.select("trajectory_id", (e * 7 % 360).cast("double").alias("a"), (e * 7 % 360 + e % 23).cast("double").alias("b"), "event_id")
    order = Window.partitionBy("trajectory_id").orderBy("a", "b", "event_id")
    i = i.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    i = runs(i, ["trajectory_id"], ["a", "b", "event_id"], c("a") > c("reach"))
    return i.groupBy("trajectory_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).drop("run")


@query("progress_terms", path(f"SELECT event_id, round(before - goal, 5) AS gained_km FROM s WHERE before IS NOT NULL", g=f"SELECT *, {O.haversine_km('lat', 'lon', '31.0::DOUBLE', '104.5::DOUBLE')} AS goal FROM track_path", s=f"SELECT *, lag(goal) {ORDER} AS before FROM g"))
def progress_terms(spark, folder):
    """How much nearer to the goal each step has come."""
    p = A.track_path(spark, folder).withColumn("goal", geo.haversine_km(c("lat"), c("lon"), F.lit(31.0), F.lit(104.5)))
    return p.withColumn("before", F.lag("goal").over(along())).where("before is not null").select("event_id", F.round(c("before") - c("goal"), 5).alias("gained_km"))


@query("gae_returns", path("SELECT event_id, round(adv, 6) AS advantage FROM w", n="SELECT event_id, trajectory_id, CAST(event_id % 11 AS DOUBLE) / 10 AS reward, CAST(event_id % 7 AS DOUBLE) / 10 AS value, row_number() OVER (PARTITION BY trajectory_id ORDER BY t DESC, event_id DESC) AS k, lag(CAST(event_id % 7 AS DOUBLE) / 10) OVER (PARTITION BY trajectory_id ORDER BY t DESC, event_id DESC) AS next_value FROM track_path",
    w="SELECT event_id, trajectory_id, k, reward + 0.99::DOUBLE * coalesce(next_value, 0) - value AS adv FROM n WHERE k = 1 UNION ALL SELECT n.event_id, n.trajectory_id, n.k, n.reward + 0.99::DOUBLE * n.next_value - n.value + 0.99::DOUBLE * 0.95::DOUBLE * w.adv FROM n JOIN w ON n.trajectory_id = w.trajectory_id AND n.k = w.k + 1").replace("WITH ", "WITH RECURSIVE ", 1))
def gae_returns(spark, folder):
    """Generalised advantages of each trajectory, from its last step back, by a fold over its steps."""
    e = c("event_id")
    p = A.track_path(spark, folder).select("trajectory_id", "t", "event_id", ((e % 11).cast("double") / 10).alias("reward"), ((e % 7).cast("double") / 10).alias("value"))
    g = p.groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "reward", "value")), asc=False).alias("steps"))
    zero = F.struct(F.lit(0.0).alias("adv"), F.lit(0.0).alias("value"), F.array().cast("array<struct<event_id:bigint,advantage:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        adv = x["reward"] + 0.99 * s["value"] - x["value"] + 0.99 * 0.95 * s["adv"]
        row = F.struct(x["event_id"].alias("event_id"), F.round(adv, 6).alias("advantage"))
        return F.struct(adv.alias("adv"), x["value"].alias("value"), F.concat(s["out"], F.array(row)).alias("out"))

    return g.select(F.explode(F.aggregate("steps", zero, step, lambda s: s["out"])).alias("o")).select("o.event_id", "o.advantage")


@query("conflict_onsets", O.with_views("SELECT trajectory_id, count_if(hit AND NOT coalesce(was, false)) AS onsets, count_if(NOT hit AND coalesce(was, false)) AS cleared FROM s GROUP BY 1", "tracks",
    s="SELECT *, vs_mps > 0 AS hit, lag(vs_mps > 0) OVER (PARTITION BY trajectory_id ORDER BY tick) AS was FROM tracks"))
def conflict_onsets(spark, folder):
    """Rising and falling edges of a flag along each aircraft's ticks (here: climbing)."""
    hit = c("vs_mps") > 0
    t = A.tracks(spark, folder).withColumns({"hit": hit, "was": F.lag(hit).over(Window.partitionBy("trajectory_id").orderBy("tick"))})
    return t.groupBy("trajectory_id").agg(F.count_if(c("hit") & ~F.coalesce("was", F.lit(False))).alias("onsets"), F.count_if(~c("hit") & c("was")).alias("cleared"))


@query("arrived_left_sets", O.with_views("SELECT tick, trajectory_id, CASE WHEN next_tick IS NULL OR next_tick > tick + 1 THEN true ELSE false END AS leaves, CASE WHEN prev_tick IS NULL OR prev_tick < tick - 1 THEN true ELSE false END AS arrives FROM s WHERE next_tick IS NULL OR next_tick > tick + 1 OR prev_tick IS NULL OR prev_tick < tick - 1", "tracks",
    s="SELECT tick, trajectory_id, lead(tick) OVER w AS next_tick, lag(tick) OVER w AS prev_tick FROM tracks WINDOW w AS (PARTITION BY trajectory_id ORDER BY tick)"))
def arrived_left_sets(spark, folder):
    """Members of a tick that were not there in the tick before, or are not in the next."""
    t = A.tracks(spark, folder).select("tick", "trajectory_id")
    before, after = (t.select((c("tick") + d).alias("tick"), "trajectory_id") for d in (1, -1))
    arrives, leaves = t.join(before, ["tick", "trajectory_id"], "left_anti").withColumn("arrives", F.lit(True)), t.join(after, ["tick", "trajectory_id"], "left_anti").withColumn("leaves", F.lit(True))
    return arrives.join(leaves, ["tick", "trajectory_id"], "full").fillna(False, ["arrives", "leaves"])


@query("filter_valid_traffic", path("SELECT event_id FROM track_path WHERE event_id % 9 <> 0"))
def filter_valid_traffic(spark, folder):
    """Reports whose numbers are all finite; every ninth has none."""
    p = A.track_path(spark, folder).withColumn("x", F.when(c("event_id") % 9 == 0, F.when(c("event_id") % 2 == 0, float("nan"))).otherwise(c("gs_mps")))
    numbers = [c(n) for n in ("lat", "lon", "alt_m", "x", "trk_deg")]
    fine = F.lit(True)
    for n in numbers:
        fine = fine & n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return p.where(fine).select("event_id")


@query("filter_low_slow", path("SELECT event_id FROM track_path WHERE (gs_mps < 210 AND alt_m < 9000) OR (vs_mps < -1 AND alt_m < 8300) OR gs_mps < 201"))
def filter_low_slow(spark, folder):
    low = ((c("gs_mps") < 210) & (c("alt_m") < 9000)) | ((c("vs_mps") < -1) & (c("alt_m") < 8300)) | (c("gs_mps") < 201)
    return A.track_path(spark, folder).where(low).select("event_id")


POLYGON = ((30.1, 103.2), (30.9, 103.4), (30.7, 104.3), (30.2, 104.1))
_EDGES = [[f"{v}::DOUBLE" for v in (*a, *b)] for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1])]
_RAY = " + ".join(
    f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for y1, x1, y2, x2 in _EDGES
)


def in_polygon(lat: Column, lon: Column, vertices: Column) -> Column:
    """Whether a point is in a polygon given as an array of (lat, lon): the parity of edges that a ray to the east cuts."""
    n = F.size(vertices)

    def cuts(i: Column) -> Column:
        a, b = F.get(vertices, i), F.get(vertices, (i + 1) % n)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), cuts), F.lit(0), lambda s, x: s + x) % 2 == 1


@query("filter_area_polygon", path(f"SELECT event_id FROM track_path WHERE ({_RAY}) % 2 = 1 AND alt_m BETWEEN 8300 AND 11000"))
def filter_area_polygon(spark, folder):
    ring = F.array(*[F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in POLYGON])
    return A.track_path(spark, folder).where(in_polygon(c("lat"), c("lon"), ring) & c("alt_m").between(8300, 11000)).select("event_id")


@query("filter_area_circle", path("SELECT event_id FROM track_path WHERE 6371000.0::DOUBLE * sqrt(pow(radians(30.5::DOUBLE - lat), 2) + pow(radians(103.75::DOUBLE - lon) * cos(radians(lat + 30.5::DOUBLE) * 0.5), 2)) / 1852 <= 20.01"))
def filter_area_circle(spark, folder):
    return A.track_path(spark, folder).where(geo.flat_distance_nm(c("lat"), c("lon"), F.lit(30.5), F.lit(103.75)) <= 20.01).select("event_id")


@query("filter_area_box", path("SELECT event_id FROM track_path WHERE lat BETWEEN 30.2 AND 30.8 AND lon BETWEEN 103.3 AND 104.2 AND alt_m BETWEEN 8300 AND 11000"))
def filter_area_box(spark, folder):
    return A.track_path(spark, folder).where(c("lat").between(30.2, 30.8) & c("lon").between(103.3, 104.2) & c("alt_m").between(8300, 11000)).select("event_id")


_AREAS = "SELECT r_regionkey AS area, 30.1 + 0.15::DOUBLE * r_regionkey AS south, 30.5 + 0.15::DOUBLE * r_regionkey AS north, 103.1 + 0.2::DOUBLE * r_regionkey AS west, 103.9 + 0.2::DOUBLE * r_regionkey AS east FROM region"


def areas(spark, folder) -> DataFrame:
    """A box per region; the table has a row per region, so its size is fixed."""
    k = c("r_regionkey")
    return table(spark, folder, "region").select(
        k.alias("area"), (30.1 + 0.15 * k).alias("south"), (30.5 + 0.15 * k).alias("north"), (103.1 + 0.2 * k).alias("west"), (103.9 + 0.2 * k).alias("east")
    )


def in_areas(states: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every state with every area that it is in, by an equi-join on whole degrees that a box touches."""
    cells = lambda a, b: F.sequence(F.floor(a), F.floor(b))
    cut = boxes.withColumn("cy", F.explode(cells(c("south"), c("north")))).withColumn("cx", F.explode(cells(c("west"), c("east"))))
    found = states.withColumns({"cy": F.floor("lat"), "cx": F.floor("lon")}).join(cut, ["cy", "cx"])
    return found.where(c("lat").between(c("south"), c("north")) & c("lon").between(c("west"), c("east"))).drop("cx", "cy")


@query("spatial_join_areas", path("SELECT p.event_id, a.area FROM track_path p JOIN a ON lat BETWEEN south AND north AND lon BETWEEN west AND east", a=_AREAS))
def spatial_join_areas(spark, folder):
    return in_areas(A.track_path(spark, folder), areas(spark, folder)).select("event_id", "area")


@query("sector_density", O.with_views("SELECT tick, area, count(*) AS n FROM tracks p JOIN a ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL", "tracks", a=_AREAS))
def sector_density(spark, folder):
    return in_areas(A.tracks(spark, folder), areas(spark, folder)).groupBy("tick", "area").agg(F.count("*").alias("n"))


@query("geovector_violations", path("SELECT event_id, greatest(205.0::DOUBLE, least(250.0::DOUBLE, gs_mps)) AS gs_ok, CASE WHEN gs_mps < 205 THEN 'slow' WHEN gs_mps > 250 THEN 'fast' ELSE '' END AS side FROM track_path p JOIN a ON lat BETWEEN south AND north AND lon BETWEEN west AND east WHERE area = 2", a=_AREAS))
def geovector_violations(spark, folder):
    """In an area with limits on ground speed: which side is exceeded, and the value held to the limits."""
    inside = in_areas(A.track_path(spark, folder), areas(spark, folder).where("area = 2"))
    side = F.when(c("gs_mps") < 205, "slow").when(c("gs_mps") > 250, "fast").otherwise("")
    return inside.select("event_id", F.greatest(F.lit(205.0), F.least(F.lit(250.0), c("gs_mps"))).alias("gs_ok"), side.alias("side"))


_WPT = "SELECT s_suppkey AS wpt, s_suppkey % 40 AS name, 30 + CAST(s_suppkey * 29 % 1000 AS DOUBLE) / 1000 AS wlat, 103 + CAST(s_suppkey * 31 % 1500 AS DOUBLE) / 1000 AS wlon FROM supplier"


def waypoints(spark, folder) -> DataFrame:
    k = c("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("wpt"), (k % 40).alias("name"), (30 + (k * 29 % 1000).cast("double") / 1000).alias("wlat"), (103 + (k * 31 % 1500).cast("double") / 1000).alias("wlon")
    )


_WRAPPED = "((wlon - lon + 540) % 360 - 180)"


@query("nearest_point_join", O.with_views(f"SELECT event_id, wpt FROM tracks t CROSS JOIN w QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(pow({_WRAPPED} * cos(radians(lat)), 2) + pow(wlat - lat, 2), 12), wpt) = 1", "tracks", w=_WPT))
def nearest_point_join(spark, folder):
    """The nearest waypoint of each state, by cells that are widened until one is sure to be the nearest."""
    return spatial.nearest_points(A.tracks(spark, folder).select("event_id", "lat", "lon"), waypoints(spark, folder))


@query("resolve_name_nearest", O.with_views("SELECT event_id, wpt FROM (SELECT *, event_id % 40 AS name FROM tracks) t JOIN w USING (name) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(pow((wlon - lon) * cos(radians(lat)), 2) + pow(wlat - lat, 2), 12), wpt) = 1", "tracks", w=_WPT))
def resolve_name_nearest(spark, folder):
    """Of the waypoints with a state's name, the one nearest to it."""
    t = A.tracks(spark, folder).select("event_id", "lat", "lon", (c("event_id") % 40).alias("name"))
    return spatial.nearest_points(t, waypoints(spark, folder), by=["name"], wrapped=False)


#: Whole numbers, as bounds of frames are.
SPEED_KT, HEADING_DEG, CLIMB_FPM = 35, 20, 500


def cell_metrics(reports: DataFrame, window_s: float) -> DataFrame:
    """Per cell and window: aircraft, how long they stay in it as a share of the window, ordered pairs of them that differ
    in speed, heading or vertical sense, these by the occupancy, and the complexity made of the four.

    ``reports(cell, trajectory_id, t, gs_mps, trk_deg, vs_mps)``. An aircraft counts with its first report in a cell and
    window, and stays until its last. Pairs are not joined: those that differ little are counted by frames of a range
    about each aircraft's value, headings round the circle, and all others differ. Ratios are null without occupancy.
    """
    window = F.floor(c("t") / window_s).alias("window")
    first = F.min_by(F.struct("gs_mps", "trk_deg", "vs_mps"), F.struct("t", "gs_mps", "trk_deg", "vs_mps"))
    stays = reports.groupBy("cell", window, "trajectory_id").agg((F.max("t") - F.min("t")).alias("stay"), first.alias("f"))
    fpm = c("f.vs_mps") * 60 / 0.3048
    sense = F.when(fpm > CLIMB_FPM, 1).when(fpm < -CLIMB_FPM, -1).otherwise(0)
    each = stays.select("cell", "window", "stay", (c("f.gs_mps") * 3600 / 1852).alias("kt"), F.pmod(c("f.trk_deg"), F.lit(360.0)).alias("deg"), sense.alias("sense"))
    group = Window.partitionBy("cell", "window")
    within = lambda order, low, high: F.count("*").over(order.rangeBetween(low, high))
    speeds, turns = group.orderBy("kt"), group.orderBy("deg")
    alike = {
        "same_speed": within(speeds, -SPEED_KT, SPEED_KT), "same_sense": F.count("*").over(Window.partitionBy("cell", "window", "sense")),
        "same_heading": within(turns, -HEADING_DEG, HEADING_DEG) + within(turns, 360 - HEADING_DEG, Window.unboundedFollowing) + within(turns, Window.unboundedPreceding, HEADING_DEG - 360),
    }
    n = F.count("*")
    counted = each.withColumns(alike).groupBy("cell", "window").agg(
        n.alias("aircraft"), (F.sum("stay") / window_s).alias("occupancy"), (n * (n - 1)).alias("pairs"),
        *[(n * n - F.sum(f"same_{k}")).alias(f"{k}_pairs") for k in ("speed", "heading", "sense")],
    )
    ratio = lambda k: F.when(c("occupancy") > 0, c(k) / c("occupancy"))
    mixed = ratio("speed_pairs") + ratio("heading_pairs") + ratio("sense_pairs")
    return counted.withColumns({"pair_ratio": ratio("pairs"), "complexity": ratio("pairs") * mixed})


@query("cell_interactions", path("""SELECT g.cell, g.win AS window_at, aircraft, round(occ, 6) AS occupancy, aircraft * (aircraft - 1) AS pairs, coalesce(speed_pairs, 0) AS speed_pairs, coalesce(heading_pairs, 0) AS heading_pairs, coalesce(sense_pairs, 0) AS sense_pairs,
    CASE WHEN occ > 0 THEN round(aircraft * (aircraft - 1) / occ, 4) END AS pair_ratio, CASE WHEN occ > 0 THEN round(aircraft * (aircraft - 1) / occ * (coalesce(speed_pairs, 0) + coalesce(heading_pairs, 0) + coalesce(sense_pairs, 0)) / occ, 3) END AS complexity
    FROM (SELECT cell, win, count(*) AS aircraft, sum(stay) / 86400 AS occ FROM st GROUP BY 1, 2) g LEFT JOIN (SELECT a.cell, a.win, count_if(abs(a.kt - b.kt) > 35) AS speed_pairs,
        count_if(least(abs(a.trk_deg - b.trk_deg), 360 - abs(a.trk_deg - b.trk_deg)) > 20) AS heading_pairs, count_if(a.sense <> b.sense) AS sense_pairs FROM st a JOIN st b ON a.cell = b.cell AND a.win = b.win AND a.trajectory_id <> b.trajectory_id GROUP BY 1, 2) p ON p.cell = g.cell AND p.win = g.win""",
    k="SELECT *, CAST(floor(t / 86400) AS BIGINT) AS win, CAST(floor((lat - 30) * 3) * 1000 + floor((lon - 103) * 3) * 10 + floor((alt_m - 8000) / 914.4::DOUBLE) AS BIGINT) AS cell FROM track_path",
    st="""SELECT *, gs_mps * 3600 / 1852 AS kt, CASE WHEN vs_mps * 60 / 0.3048::DOUBLE > 500 THEN 1 WHEN vs_mps * 60 / 0.3048::DOUBLE < -500 THEN -1 ELSE 0 END AS sense, max(t) OVER (PARTITION BY cell, win, trajectory_id) - t AS stay
        FROM k QUALIFY row_number() OVER (PARTITION BY cell, win, trajectory_id ORDER BY t, gs_mps, trk_deg, vs_mps) = 1"""))
def cell_interactions(spark, folder):
    """Occupancy and interactions per cell of 20 NM and 3000 ft, day by day, for reports that are hours apart."""
    cell = (F.floor((c("lat") - 30) * 3) * 1000 + F.floor((c("lon") - 103) * 3) * 10 + F.floor((c("alt_m") - 8000) / 914.4)).alias("cell")
    m = cell_metrics(A.track_path(spark, folder).select(cell, "trajectory_id", "t", "gs_mps", "trk_deg", "vs_mps"), 86_400.0)
    return m.select(
        "cell", c("window").alias("window_at"), "aircraft", F.round("occupancy", 6).alias("occupancy"), "pairs", "speed_pairs", "heading_pairs", "sense_pairs",
        F.round("pair_ratio", 4).alias("pair_ratio"), F.round("complexity", 3).alias("complexity"),
    )


@query("group_membership", path("SELECT CASE WHEN lat > 30.5 THEN 'north' ELSE 'south' END AS grp, count(DISTINCT trajectory_id) AS members FROM track_path GROUP BY 1"))
def group_membership(spark, folder):
    """Groups by area, each with its members once."""
    p = A.track_path(spark, folder).select(F.when(c("lat") > 30.5, "north").otherwise("south").alias("grp"), "trajectory_id").distinct()
    return p.groupBy("grp").agg(F.count("*").alias("members"))


@query("intersect_splits", path("SELECT trajectory_id FROM track_path WHERE NOT inside AND alt_m > 11000 INTERSECT SELECT trajectory_id FROM track_path WHERE inside AND vs_mps > 1"))
def intersect_splits(spark, folder):
    """Trajectories in both of two splits."""
    p = A.track_path(spark, folder)
    return p.where("not inside and alt_m > 11000").select("trajectory_id").intersect(p.where("inside and vs_mps > 1").select("trajectory_id"))
