"""The adapter views and shared formulas in DuckDB SQL, for the twins of registered queries."""

from __future__ import annotations

SECONDS = "CAST(epoch_us(ts) AS DOUBLE) / 1000000"

VIEWS = {
    "track_path": f"""SELECT event_id, user_id AS trajectory_id, {SECONDS} AS t, CAST(floor({SECONDS} / 3600) AS BIGINT) AS tick,
        30 + CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 AS lat, 103 + CAST(event_id * 53 % 1500 AS DOUBLE) / 1000 AS lon,
        CAST(8000 + 300 * (event_id % 13) AS DOUBLE) AS alt_m, CAST(200 + user_id * 7 % 60 AS DOUBLE) AS gs_mps,
        CAST(event_id * 61 % 360 AS DOUBLE) AS trk_deg, CAST(event_id % 5 - 2 AS DOUBLE) AS vs_mps, event_type <> 'error' AS inside FROM events""",
    "tracks": """SELECT * FROM track_path QUALIFY row_number() OVER (PARTITION BY trajectory_id, tick ORDER BY t DESC, event_id DESC) = 1""",
    "refs": f"""SELECT event_id, 'CES' || CAST(100 + user_id AS VARCHAR) AS callsign, CASE WHEN event_id % 2 = 0 THEN 'altitude' ELSE 'speed' END AS family,
        CAST(CASE WHEN event_id % 2 = 0 THEN 300 * (event_id % 20) + 1200 ELSE 200 + 10 * (event_id % 12) END AS DOUBLE) AS target,
        CASE WHEN event_id % 2 = 0 THEN 'm' ELSE 'kt' END AS unit, {SECONDS} AS epoch FROM events WHERE event_type IN ('purchase', 'signup')""",
    "sys": f"""SELECT event_id, 'CES' || CAST(100 + user_id AS VARCHAR) AS callsign, CASE WHEN event_id % 2 = 0 THEN 'altitude' ELSE 'speed' END AS family,
        CAST(CASE WHEN event_id % 2 = 0 THEN 300 * (event_id % 20) + 1200 ELSE 200 + 10 * (event_id % 12) END AS DOUBLE) AS target,
        CASE WHEN event_id % 2 = 0 THEN 'm' ELSE 'kt' END AS unit, {SECONDS} AS epoch FROM events WHERE event_type IN ('click', 'view')""",
    "run_events": f"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'action_executed' WHEN event_type = 'error' THEN 'command_failed'
        ELSE 'separation_updated' END AS event, user_id AS episode, {SECONDS} AS sim_time_s, event_id % 6 AS macro_action,
        CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'NOOP' ELSE 'ALT X,FL300' END AS command, event_id % 3 <> 0 AS command_applied,
        'reason ' || CAST(event_id % 7 AS VARCHAR) AS message, CAST(event_id % 5 + 5 AS DOUBLE) AS previous_horizontal_km,
        CAST(event_id % 7 + 4 AS DOUBLE) AS horizontal_km FROM events""",
    "diagnostics": """SELECT o_orderkey AS row_id, o_custkey % 150 AS episode, '0' || CAST(o_orderkey % 9 AS VARCHAR) || '_s' AS scenario,
        CAST(o_orderstatus = 'F' AS INT) AS safe_success, CASE WHEN o_orderkey % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS collision_events,
        CAST(o_orderkey % 4 AS DOUBLE) AS safety_violations, CAST(o_orderkey % 13 AS DOUBLE) AS command_count, CAST(o_orderkey % 2 AS DOUBLE) AS arrival,
        CASE WHEN o_orderstatus = 'P' THEN -1.0::DOUBLE ELSE CAST(o_orderkey % 5000 AS DOUBLE) / 100 END AS min_contact_horizontal_km,
        CAST(o_orderkey % 17 AS DOUBLE) AS episode_return, CAST(o_orderkey % 5 + 5 AS DOUBLE) AS separation_horizontal_km FROM orders""",
    "pairs": """SELECT a.tick, a.trajectory_id AS id1, b.trajectory_id AS id2, a.lat AS lat1, a.lon AS lon1, a.alt_m AS alt1, a.gs_mps AS gs1,
        a.trk_deg AS trk1, a.vs_mps AS vs1, b.lat AS lat2, b.lon AS lon2, b.alt_m AS alt2, b.gs_mps AS gs2, b.trk_deg AS trk2, b.vs_mps AS vs2
        FROM tracks a JOIN tracks b ON a.tick = b.tick AND a.trajectory_id < b.trajectory_id""",
    "opairs": """SELECT a.tick, a.trajectory_id AS id1, b.trajectory_id AS id2, a.lat AS lat1, a.lon AS lon1, a.alt_m AS alt1, a.gs_mps AS gs1,
        a.trk_deg AS trk1, a.vs_mps AS vs1, b.lat AS lat2, b.lon AS lon2, b.alt_m AS alt2, b.gs_mps AS gs2, b.trk_deg AS trk2, b.vs_mps AS vs2
        FROM tracks a JOIN tracks b ON a.tick = b.tick AND a.trajectory_id <> b.trajectory_id""",
    "rel": """SELECT *, (lon2 - lon1) * 60 * cos(radians(30.92095)) AS rx, (lat2 - lat1) * 60 AS ry,
        gs2 / 1852 * sin(radians(trk2)) - gs1 / 1852 * sin(radians(trk1)) AS vx, gs2 / 1852 * cos(radians(trk2)) - gs1 / 1852 * cos(radians(trk1)) AS vy FROM pairs""",
    "cpa0": """SELECT *, CASE WHEN vx * vx + vy * vy <= 1e-12 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(300.0::DOUBLE, -(rx * vx + ry * vy) / (vx * vx + vy * vy))) END AS tcpa FROM rel""",
    "cpa": """SELECT *, sqrt((rx + vx * tcpa) * (rx + vx * tcpa) + (ry + vy * tcpa) * (ry + vy * tcpa)) AS cpa_nm, sqrt(rx * rx + ry * ry) AS now_nm FROM cpa0""",
}
_NEEDS = {"tracks": ["track_path"], "pairs": ["tracks"], "opairs": ["tracks"], "rel": ["pairs"], "cpa0": ["rel"], "cpa": ["cpa0"]}


def with_views(body: str, *names: str, **own: str) -> str:
    """``body`` under the views it names, those that they need, and further ones of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order] + [f"{name} AS ({sql})" for name, sql in own.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def r6(x: str, digits: int = 6) -> str:
    """A rounded double; adding zero takes the sign from a negative zero."""
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def pmod(a: str, n: str = "360.0::DOUBLE") -> str:
    return f"((({a}) % {n} + {n}) % {n})"


def wrap180(a: str) -> str:
    return f"({pmod(f'({a}) + 180')} - 180)"


def radius(lat: str) -> str:
    c, s = f"cos(radians({lat}))", f"sin(radians({lat}))"
    a, b = "6378137.0::DOUBLE", "6356752.314245::DOUBLE"
    return f"sqrt((pow({a}*{a}*{c}, 2) + pow({b}*{b}*{s}, 2)) / (pow({a}*{c}, 2) + pow({b}*{s}, 2)))"


def angle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0.0::DOUBLE))))"


def distance_nm(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    across = f"0.5 * (abs({lat1}) * ({radius(lat1)} + 6378137.0) + abs({lat2}) * ({radius(lat2)} + 6378137.0)) / greatest(abs({lat1}) + abs({lat2}), 0.001::DOUBLE)"
    r = f"CASE WHEN {lat1} * {lat2} >= 0 THEN {radius(f'(0.5 * ({lat1} + {lat2}))')} ELSE {across} END"
    return f"(({r}) * {angle(lat1, lon1, lat2, lon2)} / 1852.0::DOUBLE)"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(6371.0::DOUBLE * {angle(lat1, lon1, lat2, lon2)})"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    p1, p2, dl = f"radians({lat1})", f"radians({lat2})", f"radians({lon2} - {lon1})"
    return f"degrees(atan2(sin({dl}) * cos({p2}), cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({dl})))"


def density(h: str) -> str:
    return f"(1.225::DOUBLE * pow(greatest(288.15::DOUBLE - 0.0065::DOUBLE * {h}, 216.65::DOUBLE) / 288.15::DOUBLE, 4.256848030018761::DOUBLE) * exp(-greatest({h} - 11000.0::DOUBLE, 0.0::DOUBLE) / 6341.552161::DOUBLE))"


def temperature(h: str) -> str:
    return f"greatest(288.15::DOUBLE - 0.0065::DOUBLE * {h}, 216.65::DOUBLE)"
