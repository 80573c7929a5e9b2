"""Registered streaming queries, run to the end of their source, with DuckDB twins of the batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators.pairs import once
from skyledger.operators.traffic_blocks import approach_counts
from skyledger.operators.policy_queries import GATE_SQL, with_phase
from skyledger.plans import oracle as O
from skyledger.registry import query
from skyledger.sources.modes import fields
from skyledger.sources.queries import MESSAGES, messages
from skyledger.session import stage_table
from skyledger.streaming import lives as V
from skyledger.streaming import operators as S
from skyledger.streaming import stateful as K
from skyledger.streaming.runs import as_stream, finished, folded, stream_table

c = F.col
_HOURS = "CAST(floor(t / {w}) * {w} AS BIGINT) AS start_s"


def track(spark, folder):
    return S.positions(stream_table(spark, folder, "events"))


def path(body: str, **own: str) -> str:
    return O.with_views(body, "track_path", **own)


@query("stream_sector_occupancy", path(f"SELECT {_HOURS.format(w=3600)}, count(*) AS reports, max(alt_m) AS highest_m FROM track_path WHERE inside GROUP BY 1"))
def stream_sector_occupancy(spark, folder):
    return finished(S.sector_occupancy(track(spark, folder)), "update", ["start_s"])


@query("stream_periodic_sample", path(f"SELECT {_HOURS.format(w=21600)}, trajectory_id, arg_min(event_id, t) AS first_id, arg_max(event_id, t) AS last_id FROM track_path GROUP BY 1, 2"))
def stream_periodic_sample(spark, folder):
    return finished(S.periodic_sample(track(spark, folder)), "update", ["start_s", "trajectory_id"])


@query("stream_sliding_density", path("SELECT CAST((floor(t / 3600) - k) * 3600 AS BIGINT) AS start_s, CAST(floor(lat * 2) AS BIGINT) AS cy, CAST(floor(lon * 2) AS BIGINT) AS cx, count(*) AS reports FROM track_path CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY 1, 2, 3"))
def stream_sliding_density(spark, folder):
    return finished(S.sliding_density(track(spark, folder)), "update", ["start_s", "cy", "cx"])


_SESSION = "SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 10800 THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, t - lag(t) OVER (PARTITION BY trajectory_id ORDER BY t, event_id) AS gap FROM track_path)"


@query("stream_stale_eviction", path("SELECT trajectory_id, CAST(round(min(t) * 1000000) AS BIGINT) AS first_us, CAST(round(max(t) * 1000000) AS BIGINT) AS last_us, count(*) AS reports FROM g GROUP BY trajectory_id, s", g=_SESSION))
def stream_stale_eviction(spark, folder):
    """Session windows give their rows when they close; a last run without new data closes none, so the batch of all
    rows is complete mode's."""
    return finished(S.activity_sessions(track(spark, folder)), "complete", ["trajectory_id", "first_us"])


@query("stream_command_dedup", path("SELECT event_id, trajectory_id FROM track_path"))
def stream_command_dedup(spark, folder):
    return finished(S.command_dedup(track(spark, folder)), "append", ["event_id"]).select("event_id", "trajectory_id")


@query("stream_session_events", "SELECT user_id AS trajectory_id, count(*) AS events, arg_max(event_type, ts) AS last_kind FROM events GROUP BY 1")
def stream_session_events(spark, folder):
    return finished(S.session_events(track(spark, folder)), "update", ["trajectory_id"])


@query("stream_crossing_trigger", path("SELECT trajectory_id, arg_min(event_id, t) AS event_id FROM s WHERE was IS NOT NULL AND was <> above GROUP BY 1",
    s="SELECT *, alt_m > 9950 AS above, lag(alt_m > 9950) OVER (PARTITION BY trajectory_id ORDER BY t, event_id) AS was FROM track_path"))
def stream_crossing_trigger(spark, folder):
    fired = finished(S.crossing_trigger(track(spark, folder)), "update", ["trajectory_id"])
    return fired.where("time is not null").select("trajectory_id", "event_id")


# -- state per key --------------------------------------------------------------------------------------------------------


def timed(spark, folder):
    i = c("event_id")
    return track(spark, folder).withColumns({"t": F.unix_micros("time").cast("double") / 1000000, "target_m": F.when(i % 6 == 0, c("alt_m") + 600)})


@query("stream_track_ingest", path("SELECT trajectory_id, count(*) AS reports FROM track_path GROUP BY 1"))
def stream_track_ingest(spark, folder):
    """Reports without repetitions, counted per aircraft."""
    return finished(S.command_dedup(track(spark, folder)), "append", ["event_id"]).groupBy("trajectory_id").agg(F.count("*").alias("reports"))


@query("stream_cooldown_gate", GATE_SQL)
def stream_cooldown_gate(spark, folder):
    """The gate on a stream of commands: the same rules, row for row, as on a table."""
    e = stream_table(spark, folder, "events").where(c("event_type").isin("click", "view"))
    altitude, i = c("event_id") % 2 == 0, c("event_id")
    commands = e.select(
        i, c("ts").cast("timestamp").alias("time"), F.concat(F.lit("CES"), (100 + c("user_id")).cast("string")).alias("callsign"), F.when(altitude, "altitude").otherwise("speed").alias("family"),
        F.when(altitude, 300 * (i % 20) + 1200).otherwise(200 + 10 * (i % 12)).cast("double").alias("target"), (F.unix_micros(c("ts").cast("timestamp")).cast("double") / 1000000).alias("epoch"),
    )
    return folded(K.cooldown_gate(with_phase(commands)))


_NUMBERED = "SELECT *, CASE WHEN event_id % 6 = 0 THEN alt_m + 600 END AS target_m, CAST(event_id * 17 % 101 AS DOUBLE) AS risk, row_number() OVER (PARTITION BY trajectory_id ORDER BY t, event_id) AS n FROM track_path"
_KINDS = """SELECT trajectory_id, event_id, t, kind, CASE kind WHEN 'altitude' THEN alt_m ELSE gs_mps + event_id % 23 END AS value, CASE kind WHEN 'altitude' THEN 300.0::DOUBLE ELSE 5.0::DOUBLE END AS tolerance,
    CASE WHEN kind = 'altitude' AND event_id % 6 = 0 THEN alt_m + 600 WHEN kind = 'speed' AND event_id % 5 = 0 THEN gs_mps + event_id % 23 + 10 END AS target, row_number() OVER (PARTITION BY trajectory_id, kind ORDER BY t, event_id) AS n FROM track_path CROSS JOIN (VALUES ('altitude'), ('speed')) v(kind)"""
_EXECUTED = """SELECT trajectory_id, kind, n, target AS goal, CASE WHEN target IS NOT NULL THEN t END AS since, value AS start, false AS begun, NULL::VARCHAR AS told, CASE WHEN target IS NOT NULL THEN 'planned' END AS given, CAST(NULL AS DOUBLE) AS seconds FROM x WHERE n = 1
    UNION ALL SELECT trajectory_id, kind, n, CASE WHEN target IS NOT NULL THEN target WHEN near THEN NULL ELSE goal END, CASE WHEN target IS NOT NULL THEN t ELSE since END, CASE WHEN target IS NOT NULL THEN value ELSE start END,
        CASE WHEN target IS NOT NULL THEN false ELSE begun OR coalesce(moves, false) END, CASE WHEN near THEN 'reached' WHEN moves AND target IS NOT NULL THEN 'executing,superseded' WHEN moves THEN 'executing' WHEN goal IS NOT NULL AND target IS NOT NULL THEN 'superseded' END,
        CASE WHEN target IS NOT NULL THEN 'planned' END, t - since
    FROM (SELECT x.*, w.goal, w.since, w.start, w.begun, abs(x.value - w.goal) <= x.tolerance AS near, abs(x.value - w.goal) > x.tolerance AND NOT w.begun AND (x.t - w.since > 300 OR abs(x.value - w.goal) <= 0.9::DOUBLE * abs(w.goal - w.start)) AS moves
        FROM x JOIN walk w ON x.trajectory_id = w.trajectory_id AND x.kind = w.kind AND x.n = w.n + 1)"""
_STALLED = """SELECT trajectory_id, n, risk AS best, 0 AS stalled, CAST(NULL AS DOUBLE) AS until, false AS told FROM x WHERE n = 1
    UNION ALL SELECT trajectory_id, n, CASE WHEN paused THEN best WHEN better OR stuck THEN risk ELSE best END, CASE WHEN paused THEN stalled WHEN better OR stuck THEN 0 ELSE stalled + 1 END,
        CASE WHEN paused THEN until WHEN NOT better AND stuck THEN t + 7200 END, NOT paused AND NOT better AND stuck
    FROM (SELECT x.*, w.best, w.stalled, w.until, coalesce(x.t < w.until, false) AS paused, x.risk < w.best AS better, w.stalled = 1 AS stuck FROM x JOIN walk w ON x.trajectory_id = w.trajectory_id AND x.n = w.n + 1)"""


def walked(body: str, walk: str, rows: str = _NUMBERED, **own: str) -> str:
    return path(body, x=rows, walk=walk, **own).replace("WITH ", "WITH RECURSIVE ", 1)


@query("stream_command_execution", walked("SELECT kind, status, count(*) AS n, round(avg(seconds), 3) AS mean_s FROM (SELECT kind, unnest(string_split(told, ',')) AS status, seconds FROM walk UNION ALL SELECT kind, given, 0.0::DOUBLE FROM walk WHERE given IS NOT NULL) GROUP BY 1, 2", _EXECUTED, _KINDS))
def stream_command_execution(spark, folder):
    """How many commands of a kind were planned, carried out, reached and superseded, and after how long."""
    speed = c("gs_mps") + c("event_id") % 23
    kinds = [
        F.struct(F.lit("altitude").alias("kind"), c("alt_m").alias("value"), c("target_m").alias("target"), F.lit(300.0).alias("tolerance")),
        F.struct(F.lit("speed").alias("kind"), speed.alias("value"), F.when(c("event_id") % 5 == 0, speed + 10).alias("target"), F.lit(5.0).alias("tolerance")),
    ]
    reports = timed(spark, folder).select("trajectory_id", "time", "t", "event_id", F.inline(F.array(*kinds)))
    return folded(K.command_execution(reports)).groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 3).alias("mean_s"))


_ISLAND = "SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY trajectory_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM track_path"


@query("stream_clear_window", path("SELECT trajectory_id, arg_min(event_id, t) AS event_id FROM (SELECT *, min(t) OVER (PARTITION BY trajectory_id, k) AS since FROM g WHERE inside) WHERE t - since >= 7200 GROUP BY trajectory_id, k", g=_ISLAND))
def stream_clear_window(spark, folder):
    return folded(K.clear_window(timed(spark, folder).withColumn("clear", c("inside")), 7200.0))


@query("stream_replan_stall", walked("SELECT trajectory_id, count(*) AS replans FROM walk WHERE told GROUP BY 1", _STALLED))
def stream_replan_stall(spark, folder):
    risks = timed(spark, folder).withColumn("risk", (c("event_id") * 17 % 101).cast("double"))
    return folded(K.replan_stall(risks)).groupBy("trajectory_id").agg(F.count("*").alias("replans"))


_HEARD = "max(CASE WHEN kind = {0} THEN t END) OVER w AS t{0}"


@query("stream_adsb_fusion", path("SELECT printf('%06X', 7864320 + trajectory_id) AS icao, event_id, round(at_lat, 3) AS lat, round(at_lon, 3) AS lon, called AS name FROM heard WHERE abs(t0 - t1) <= 864000 AND t2 IS NOT NULL AND t3 IS NOT NULL",
    msg=MESSAGES, heard=f"SELECT *, {', '.join(_HEARD.format(k) for k in range(4))} FROM msg WHERE valid WINDOW w AS (PARTITION BY trajectory_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"))
def stream_adsb_fusion(spark, folder):
    """Where each aircraft is, from its messages: those that fail their check are left out, and frames meet within ten days."""
    heard = once(messages(timed(spark, folder)).select("event_id", "time", "t", "raw"), {"m": fields(c("raw"))}).where("m is not null")
    heard = heard.select("event_id", "time", "t", "m.icao", "m.odd", "m.cpr_lat", "m.cpr_lon", "m.alt_ft", "m.velocity.speed_kt", "m.velocity.track_deg", "m.name")
    found = K.fused_positions(folded(K.message_fusion(heard, 864_000.0)))
    return found.select("icao", "event_id", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "name")


_MONITOR = {
    "mp": """SELECT CAST(floor(a.t / 1200) * 1200 AS BIGINT) AS start_s, (b.lon - a.lon) * 60 * cos(radians(30.92095)) AS rx, (b.lat - a.lat) * 60 AS ry,
        b.gs_mps / 1852 * sin(radians(b.trk_deg)) - a.gs_mps / 1852 * sin(radians(a.trk_deg)) AS vx, b.gs_mps / 1852 * cos(radians(b.trk_deg)) - a.gs_mps / 1852 * cos(radians(a.trk_deg)) AS vy
        FROM track_path a JOIN track_path b ON floor(a.t / 1200) = floor(b.t / 1200) AND a.trajectory_id < b.trajectory_id AND abs(a.alt_m - b.alt_m) < 650""",
    "mc": "SELECT *, CASE WHEN vx * vx + vy * vy <= 1e-12 THEN 0 ELSE greatest(0.0::DOUBLE, least(300.0::DOUBLE, -(rx * vx + ry * vy) / (vx * vx + vy * vy))) END AS tc FROM mp",
}


@query("stream_conflict_monitor", path("SELECT start_s, count(*) AS n_pairs FROM mc WHERE sqrt(pow(rx + vx * tc, 2) + pow(ry + vy * tc, 2)) < 20 GROUP BY 1", **_MONITOR))
def stream_conflict_monitor(spark, folder):
    """How many pairs come within 20 NM while near in height, in each tick of 20 minutes."""
    ticks = finished(K.reports_by_tick(track(spark, folder), "20 minutes", "1 hour"), "update", ["at", "part"])
    reports = ticks.select(F.unix_seconds("at").alias("tick"), F.inline("reports"))
    return approach_counts(reports, 20.0, 650.0).select(c("tick").alias("start_s"), c("n").alias("n_pairs"))


_COMMANDS = """SELECT trajectory_id, n, target_m AS target FROM x WHERE n = 1
    UNION ALL SELECT x.trajectory_id, x.n, CASE WHEN x.target_m IS NOT NULL THEN x.target_m WHEN abs(x.alt_m - w.target) <= 300 THEN NULL ELSE w.target END FROM x JOIN walk w ON x.trajectory_id = w.trajectory_id AND x.n = w.n + 1"""
_SIX = "CAST(floor(t / 21600) AS BIGINT)"
_CLOSEST = "sqrt(pow(rx + vx * {0}, 2) + pow(ry + vy * {0}, 2))"
_FREE = "CASE WHEN vx * vx + vy * vy <= 1e-12 THEN 0 ELSE greatest(0.0::DOUBLE, least({0}::DOUBLE, -(rx * vx + ry * vy) / (vx * vx + vy * vy))) END"
_TRACKED = {
    "of_tick": f"""SELECT x.*, {_SIX} AS six, walk.target IS NOT NULL AS pending, bool_or(x.target_m IS NOT NULL) OVER (PARTITION BY x.trajectory_id, {_SIX}) AS issued FROM x JOIN walk ON x.trajectory_id = walk.trajectory_id AND x.n = walk.n
        QUALIFY row_number() OVER (PARTITION BY x.trajectory_id, {_SIX} ORDER BY x.n DESC) = 1""",
    "met": """SELECT a.six, a.trajectory_id AS id1, b.trajectory_id AS id2, a.issued OR b.issued AS issued, a.pending OR b.pending AS pending, abs(a.alt_m - b.alt_m) / 0.3048::DOUBLE AS vsep,
        (b.lon - a.lon) * 60 * cos(radians(30.92095)) AS rx, (b.lat - a.lat) * 60 AS ry, b.gs_mps / 1852 * sin(radians(b.trk_deg)) - a.gs_mps / 1852 * sin(radians(a.trk_deg)) AS vx,
        b.gs_mps / 1852 * cos(radians(b.trk_deg)) - a.gs_mps / 1852 * cos(radians(a.trk_deg)) AS vy FROM of_tick a JOIN of_tick b ON a.six = b.six AND a.trajectory_id < b.trajectory_id""",
    "seen": f"""SELECT *, {_CLOSEST.format(_FREE.format(300))} AS near_nm, {_CLOSEST.format(_FREE.format(600))} AS later_nm, sqrt(rx * rx + ry * ry) AS now_nm FROM met WHERE sqrt(rx * rx + ry * ry) <= 40""",
    "told": """SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY six) AS k, CASE WHEN now_nm < 5 AND vsep < 1000 THEN 'Loss' WHEN issued THEN 'Issued' WHEN pending THEN 'Executing' WHEN near_nm < 5 AND vsep < 1000 THEN 'Detected' WHEN later_nm < 8 AND vsep < 2000 THEN 'Monitoring' ELSE 'Removed' END AS now_is,
        (now_nm < 5 OR near_nm < 5) AND vsep < 1000 AS begins FROM seen""",
    "life": """SELECT id1, id2, k, six, begins AS live, CASE WHEN begins THEN six END AS since, CASE WHEN begins THEN now_is END AS status, begins AS changed, false AS gone, CAST(NULL AS BIGINT) AS gone_since, CAST(NULL AS BIGINT) AS gone_six FROM told WHERE k = 1
        UNION ALL SELECT id1, id2, k, six, kept AND now_is <> 'Removed', CASE WHEN NOT kept THEN NULL WHEN stays THEN since ELSE six END, CASE WHEN kept THEN now_is END, kept AND (NOT stays OR now_is <> status), live AND NOT stays, since, last_six
        FROM (SELECT t.*, l.live, l.since, l.status, l.six AS last_six, l.live AND t.six - l.six <= 1 AS stays, (l.live AND t.six - l.six <= 1) OR t.begins AS kept FROM told t JOIN life l ON l.id1 = t.id1 AND l.id2 = t.id2 AND t.k = l.k + 1)""",
}


@query("stream_conflict_tracker", walked("""SELECT id1, id2, CAST(six * 21600 AS DOUBLE) AS t, status, CAST(since * 21600 AS DOUBLE) AS first FROM life WHERE changed
    UNION ALL SELECT id1, id2, CAST((gone_six + 1) * 21600 AS DOUBLE), 'Removed', CAST(gone_since * 21600 AS DOUBLE) FROM life WHERE gone""", _COMMANDS, **_TRACKED))
def stream_conflict_tracker(spark, folder):
    """The life of each pair's conflict in ticks of six hours. Three queries, each taking up the last one's files: reports
    with their commands by aircraft; the last of a tick; and the lives of pairs by blocks of aircraft."""
    reports = as_stream(folded(K.with_commands(timed(spark, folder))), "commanded")
    states = finished(K.latest_of_tick(reports, "6 hours"), "update", ["tick", "trajectory_id"])
    states = stage_table(states.withColumnRenamed("tick", "time"), "states")
    blocks = V.blocks_for(states)
    return V.named(folded(V.ConflictLives(as_stream(states, "watched"), 21600.0, blocks)))
