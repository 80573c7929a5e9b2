"""Registered queries of the evaluation operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.operators import evaluate as E
from skyledger.plans import oracle as O
from skyledger.plans.prefix import at_rank, value_counts
from skyledger.registry import query
from skyledger.session import stage_table
from skyledger.sources import adapters as A
from skyledger.sources.tables import table

c = F.col
WINDOW_S = 3600.0
CAND = "SELECT r.callsign, r.family, r.event_id AS ref_id, s.event_id AS sys_id, abs(r.epoch - s.epoch) AS delta_s, r.target AS ref_target, s.target AS sys_target, r.unit FROM refs r JOIN sys s ON r.callsign = s.callsign AND r.family = s.family AND abs(r.epoch - s.epoch) <= 3600"


def _ordered(agrees: str = "true") -> dict[str, str]:
    """Views of the ordered matching ``m``: a row of the table of prefixes per reference, folded over the commands, then the way back."""
    cell = "{'n': dp.line[j + 1].n, 's': dp.line[j + 1].s, 'w': 0, 'dn': dp.line[j].n + 1, 'ds': dp.line[j].s - abs(r.epoch - cmds.q[j].e), 'ok': abs(r.epoch - cmds.q[j].e) <= 3600 AND r.family = cmds.q[j].f AND " + agrees + "}"
    kept = "CASE WHEN acc[-1].n > x[1].n OR (acc[-1].n = x[1].n AND acc[-1].s > x[1].s + 1e-12) THEN {'n': acc[-1].n, 's': acc[-1].s, 'w': 1, 'dn': x[1].dn, 'ds': x[1].ds, 'ok': x[1].ok} ELSE x[1] END"
    best = "CASE WHEN y.ok AND (y.dn > y.n OR (y.dn = y.n AND y.ds > y.s + 1e-12)) THEN {'n': y.dn, 's': y.ds, 'w': 2, 'dn': y.dn, 'ds': y.ds, 'ok': y.ok} ELSE y END"
    zero = "{'n': 0, 's': 0.0::DOUBLE, 'w': 0, 'dn': 0, 'ds': 0.0::DOUBLE, 'ok': false}"
    step = f"list_append(acc, list_transform([{kept}], lambda y: {best})[1])"
    return {
        "ordered_refs": "SELECT *, row_number() OVER (PARTITION BY callsign ORDER BY epoch, event_id) AS i FROM refs",
        "cmds": "SELECT callsign, list({'e': epoch, 'f': family, 'id': event_id, 't': target, 'u': unit} ORDER BY epoch, event_id) AS q FROM sys GROUP BY callsign",
        "dp": f"""SELECT callsign, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(q) + 1), lambda j: {zero}) AS line FROM cmds
            UNION ALL SELECT dp.callsign, r.i, list_reduce(list_concat([[{zero}]], list_transform(range(1, len(cmds.q) + 1), lambda j: [{cell}])), lambda acc, x: {step})
            FROM dp JOIN ordered_refs r ON r.callsign = dp.callsign AND r.i = dp.i + 1 JOIN cmds ON cmds.callsign = dp.callsign""",
        "back": """SELECT d.callsign, d.i, CAST(len(d.line) - 1 AS BIGINT) AS j, d.line[len(d.line)].w AS w FROM dp d WHERE d.i = (SELECT max(i) FROM dp x WHERE x.callsign = d.callsign)
            UNION ALL SELECT d.callsign, d.i, b.j - CASE WHEN b.w <> 0 THEN 1 ELSE 0 END, d.line[b.j - CASE WHEN b.w <> 0 THEN 1 ELSE 0 END + 1].w
            FROM back b JOIN dp d ON d.callsign = b.callsign AND d.i = b.i - CASE WHEN b.w <> 1 THEN 1 ELSE 0 END WHERE b.i > 0 AND b.j > 0""",
        "m": """SELECT b.callsign, r.family, r.event_id AS ref_id, c.q[b.j].id AS sys_id, abs(r.epoch - c.q[b.j].e) AS delta_s, r.target AS ref_target, c.q[b.j].t AS sys_target, r.unit AS ref_unit, c.q[b.j].u AS sys_unit
            FROM back b JOIN ordered_refs r ON r.callsign = b.callsign AND r.i = b.i JOIN cmds c ON c.callsign = b.callsign WHERE b.w = 2 AND b.i > 0 AND b.j > 0""",
    }


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def matched(body: str, agrees: str = "true", **more: str) -> str:
    return recursive(O.with_views(body, "refs", "sys", **_ordered(agrees), **more))


def _sides(spark, folder):
    return A.references(spark, folder), A.system_commands(spark, folder)


def _matches(spark, folder):
    """The one-to-one matching in order of time; staged, as several steps of a query read it."""
    return stage_table(E.match_ordered(*_sides(spark, folder), WINDOW_S), "matches")


@query("match_candidates", O.with_views("SELECT ref_id, sys_id, round(delta_s, 6) AS delta_s FROM cand", "refs", "sys", cand=CAND))
def match_candidates(spark, folder):
    return E.candidates(*_sides(spark, folder), WINDOW_S).select("ref_id", "sys_id", F.round("delta_s", 6).alias("delta_s"))


@query("match_events_ordered", matched("SELECT callsign, family, ref_id, sys_id, delta_s, ref_target, sys_target, ref_unit, sys_unit FROM m"))
def match_events_ordered(spark, folder):
    return E.match_ordered(*_sides(spark, folder), WINDOW_S)


@query("match_events_greedy")
def match_events_greedy(spark, folder):
    return E.match_greedy(*_sides(spark, folder), WINDOW_S)


_AGREES = "r.unit = cmds.q[j].u AND abs(r.target - cmds.q[j].t) <= CASE r.family WHEN 'altitude' THEN 100 ELSE 10 END"


@query("strict_recall", matched("SELECT family, n.n AS \"references\", coalesce(x.n, 0) AS matched, round_even(coalesce(x.n, 0) / n.n, 6) AS recall FROM (SELECT family, count(*) AS n FROM refs GROUP BY 1) n LEFT JOIN (SELECT family, count(*) AS n FROM m GROUP BY 1) x USING (family)", _AGREES))
def strict_recall(spark, folder):
    """Recall by family when the target has to agree too."""
    refs, own = _sides(spark, folder)
    strict = E.match_ordered(refs, own, WINDOW_S, strict=True).groupBy("family").agg(F.count("*").alias("matched"))
    n = refs.where("target is not null and unit <> ''").groupBy("family").agg(F.count("*").alias("references"))
    return n.join(strict, "family", "left").fillna(0, ["matched"]).withColumn("recall", E.ratio(c("matched"), c("references")))


@query("canonicalize_events", """SELECT p_partkey, CASE WHEN length(b) BETWEEN 2 AND 8 THEN b END AS callsign, CASE p_partkey % 4 WHEN 0 THEN 'altitude' WHEN 1 THEN 'speed' WHEN 2 THEN 'heading' END AS family,
    length(b) BETWEEN 2 AND 8 AND p_partkey % 4 <> 3 AS valid FROM (SELECT p_partkey, upper(replace(replace(p_brand, '#', ''), ' ', '')) AS b FROM part)""")
def canonicalize_events(spark, folder):
    """Rows whose names are in different columns, some with no known kind."""
    k = c("p_partkey") % 4
    rows = table(spark, folder, "part").select(
        "p_partkey", F.when(k == 0, c("p_brand")).alias("acid"), F.when(k != 0, c("p_brand")).alias("flight_id"),
        F.when(k == 0, "level").when(k == 1, "speed_adjust").alias("intent_type"), F.when(k == 2, "course").when(k == 3, "other").alias("type"),
    )
    return E.canonical(rows, ["acid", "flight_id"], ["intent_type", "type"], c("p_partkey").cast("double")).select("p_partkey", "callsign", "family", "valid")


_BY = """SELECT {k}, coalesce(r.n, 0) AS "references", coalesce(s.n, 0) AS outputs, coalesce(x.n, 0) AS matched, CASE WHEN coalesce(r.n, 0) > 0 THEN round_even(coalesce(x.n, 0) / r.n, 6) END AS recall,
    CASE WHEN coalesce(s.n, 0) > 0 THEN round_even(coalesce(x.n, 0) / s.n, 6) END AS precision FROM (SELECT {k}, count(*) AS n FROM refs GROUP BY {k}) r
    FULL JOIN (SELECT {k}, count(*) AS n FROM sys GROUP BY {k}) s USING ({k}) LEFT JOIN (SELECT {k}, count(*) AS n FROM m GROUP BY {k}) x USING ({k})"""


@query("recall_per_aircraft", matched(_BY.format(k="callsign")))
def recall_per_aircraft(spark, folder):
    return E.recall_per_aircraft(*_sides(spark, folder), _matches(spark, folder))


@query("recall_by_family", matched(_BY.format(k="family")))
def recall_by_family(spark, folder):
    return E.recall_by_family(*_sides(spark, folder), _matches(spark, folder))


@query("full_outer_callsign", O.with_views("SELECT callsign, r.n AS n_references, s.n AS n_outputs FROM (SELECT callsign, count(*) AS n FROM refs GROUP BY 1) r FULL JOIN (SELECT callsign, count(*) AS n FROM sys GROUP BY 1) s USING (callsign)", "refs", "sys"))
def full_outer_callsign(spark, folder):
    refs, own = (x.groupBy("callsign").agg(F.count("*").alias(n)) for x, n in zip(_sides(spark, folder), ("n_references", "n_outputs")))
    return refs.join(own, "callsign", "full")


@query("recall_summary", matched("""SELECT round_even(avg(recall), 6) AS macro_recall, CAST(sum("references") AS BIGINT) AS "references", CAST(sum(outputs) AS BIGINT) AS outputs, CAST(sum(matched) AS BIGINT) AS matched,
    round_even(sum(matched) / sum("references"), 6) AS micro_recall, round_even(sum(matched) / sum(outputs), 6) AS precision, round_even(sum(outputs) / sum("references"), 6) AS inflation FROM by_callsign""", by_callsign=_BY.format(k="callsign")))
def recall_summary(spark, folder):
    return E.recall_summary(*_sides(spark, folder), _matches(spark, folder))


@query("parameter_accuracy", matched("SELECT family, count(*) AS comparable, count_if(abs(ref_target - sys_target) <= CASE family WHEN 'altitude' THEN 100 ELSE 10 END) AS hits FROM m GROUP BY family"))
def parameter_accuracy(spark, folder):
    from skyledger.functions import text

    m = _matches(spark, folder).withColumn("ok", text.target_match(c("family"), c("ref_target"), c("ref_unit"), c("sys_target"), c("sys_unit")))
    return m.groupBy("family").agg(F.count("ok").alias("comparable"), F.count_if("ok").alias("hits"))


@query("anti_unmatched", matched("SELECT 'reference' AS side, event_id, callsign, family, target, unit FROM refs WHERE event_id NOT IN (SELECT ref_id FROM m) UNION ALL SELECT 'system', event_id, callsign, family, target, unit FROM sys WHERE event_id NOT IN (SELECT sys_id FROM m)"))
def anti_unmatched(spark, folder):
    refs, own = _sides(spark, folder)
    m = _matches(spark, folder)
    left = lambda df, key, name: df.join(m.select(c(key).alias("event_id")), "event_id", "left_anti").select(F.lit(name).alias("side"), *E.EVENT[:5])
    return left(refs, "ref_id", "reference").unionByName(left(own, "sys_id", "system"))


@query("asof_nearest", O.with_views("""SELECT r.event_id AS ref_id, s.event_id AS sys_id FROM refs r JOIN sys s USING (callsign) QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY abs(r.epoch - s.epoch), s.epoch, s.event_id) = 1""", "refs", "sys"))
def asof_nearest(spark, folder):
    """The nearest command in time of each reference, of one aircraft; of two equally near ones the earlier.

    One pass over both sides in order of time carries the last command forward and the next one back.
    """
    refs, own = _sides(spark, folder)
    seen = F.struct("epoch", "event_id")
    both = refs.select("callsign", "epoch", "event_id", F.lit(1).alias("side")).unionByName(own.select("callsign", "epoch", "event_id", F.lit(0).alias("side")))
    command = F.when(c("side") == 0, seen)
    order = Window.partitionBy("callsign").orderBy("epoch", "side", "event_id")
    both = both.withColumns({
        "before": F.last(command, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first(command, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    near = F.when(c("after").isNull() | (c("epoch") - c("before.epoch") <= c("after.epoch") - c("epoch")), c("before.event_id")).otherwise(c("after.event_id"))
    return both.where("side = 1").select(c("event_id").alias("ref_id"), near.alias("sys_id")).where("sys_id is not null")


@query("filter_reference_scope", O.with_views("SELECT event_id, callsign, target FROM refs WHERE family = 'altitude' AND target BETWEEN 1400 AND 6200", "refs"))
def filter_reference_scope(spark, folder):
    return A.references(spark, folder).where((c("family") == "altitude") & c("target").between(1400, 6200)).select("event_id", "callsign", "target")


# -- command execution ------------------------------------------------------------------------------------------------

_OUT = """SELECT *, CASE WHEN event = 'action_executed' AND command_applied THEN 'accepted' WHEN event = 'action_executed' THEN 'no_new_command' WHEN event = 'command_failed' AND command IN ('', 'NOOP') THEN 'precheck_rejected'
    WHEN event = 'command_failed' THEN 'rejected' END AS outcome FROM run_events WHERE macro_action BETWEEN 1 AND 4"""


def executed(body: str) -> str:
    return O.with_views(body, "run_events", o=_OUT)


@query("acceptance_by_macro", executed("""SELECT macro_action, CASE macro_action WHEN 1 THEN 'resume' WHEN 2 THEN 'heading' WHEN 3 THEN 'altitude' ELSE 'speed' END AS name, count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'rejected') AS rejected,
    count_if(outcome IN ('accepted', 'rejected')) AS submitted, round(count_if(outcome = 'accepted') / count_if(outcome IN ('accepted', 'rejected')), 9) AS rate FROM o GROUP BY macro_action"""))
def acceptance_by_macro(spark, folder):
    return E.acceptance_by_macro(A.run_events(spark, folder))


@query("acceptance_overall", executed("""SELECT count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'rejected') AS rejected, count_if(outcome = 'no_new_command') AS no_new_command, count_if(outcome = 'precheck_rejected') AS precheck_rejected,
    round(count_if(outcome = 'accepted') / count_if(outcome IN ('accepted', 'rejected')), 9) AS rate, 'complete' AS status FROM o"""))
def acceptance_overall(spark, folder):
    o = E.execution_outcomes(A.run_events(spark, folder)).agg(*[E.counts(x).alias(x) for x in ("accepted", "rejected", "no_new_command", "precheck_rejected")])
    n = c("accepted") + c("rejected")
    return o.withColumns({"rate": F.when(n > 0, F.round(c("accepted") / n, 9)), "status": F.when(n > 0, "complete").otherwise("not_evaluable")})


@query("failure_reasons_top", executed("SELECT coalesce(message, 'unknown') AS reason, count(*) AS n FROM o WHERE outcome = 'rejected' GROUP BY 1"))
def failure_reasons_top(spark, folder):
    o = E.execution_outcomes(A.run_events(spark, folder)).where("outcome = 'rejected'")
    return o.groupBy(F.coalesce("message", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("union_accept_reject", executed("SELECT event_id, episode, outcome = 'accepted' AS accepted, CASE WHEN outcome = 'accepted' THEN '' ELSE message END AS reason FROM o WHERE outcome IN ('accepted', 'rejected')"))
def union_accept_reject(spark, folder):
    o = E.execution_outcomes(A.run_events(spark, folder))
    part = lambda outcome, reason: o.where(c("outcome") == outcome).select("event_id", "episode", F.lit(outcome == "accepted").alias("accepted"), reason.alias("reason"))
    return part("accepted", F.lit("")).unionByName(part("rejected", F.coalesce("message", F.lit("unknown"))))


@query("sort_details", executed("SELECT episode, event_id, row_number() OVER (PARTITION BY episode ORDER BY CASE WHEN coalesce(sim_time_s, 0) = 0 THEN -1 ELSE sim_time_s END, event_id) AS place FROM o WHERE outcome IS NOT NULL"))
def sort_details(spark, folder):
    """Details in order of time within their episode; null and zero times come first."""
    t = F.when(F.coalesce("sim_time_s", F.lit(0.0)) == 0, -1.0).otherwise(c("sim_time_s"))
    o = E.execution_outcomes(A.run_events(spark, folder))
    return o.select("episode", "event_id", F.row_number().over(Window.partitionBy("episode").orderBy(t, "event_id")).alias("place"))


_SEP = """SELECT e.*, d.safe_success, CASE WHEN horizontal_km / 1.852 > previous_horizontal_km / 1.852 THEN 'tightened' WHEN horizontal_km / 1.852 < previous_horizontal_km / 1.852 THEN 'relaxed' ELSE 'unchanged' END AS change
    FROM run_events e LEFT JOIN (SELECT * FROM diagnostics QUALIFY row_number() OVER (PARTITION BY episode ORDER BY row_id DESC) = 1) d USING (episode) WHERE event = 'separation_updated'"""


@query("join_events_diagnostics", O.with_views("SELECT event_id, change, safe_success IS NOT NULL AND change <> 'unchanged' AS eligible, CASE WHEN safe_success IS NULL THEN 'no diagnostics' WHEN change = 'unchanged' THEN 'no change' WHEN safe_success <> 1 THEN 'not safe' ELSE '' END AS why_not FROM s", "run_events", "diagnostics", s=_SEP))
def join_events_diagnostics(spark, folder):
    return E.separation_changes(A.run_events(spark, folder), A.diagnostics(spark, folder)).select("event_id", "change", "eligible", "why_not")


@query("separation_change_rates", O.with_views("SELECT change, count(*) AS events, count_if(safe_success = 1) AS successes, round(count_if(safe_success = 1) / count(*), 9) AS rate FROM s WHERE change <> 'unchanged' AND safe_success IS NOT NULL GROUP BY change", "run_events", "diagnostics", s=_SEP))
def separation_change_rates(spark, folder):
    s = E.separation_changes(A.run_events(spark, folder), A.diagnostics(spark, folder)).where("eligible")
    out = s.groupBy("change").agg(F.count("*").alias("events"), F.count_if("success").alias("successes"))
    return out.withColumn("rate", F.round(c("successes") / c("events"), 9))


# -- summaries of runs ------------------------------------------------------------------------------------------------


@query("noise_baseline_summary", O.with_views("SELECT regexp_extract(scenario, '^[0-9]{2}', 0) AS prefix, count(*) AS n, round(avg(safe_success), 9) AS safe, round(avg(arrival), 9) AS arrival, round(avg(CASE WHEN collision_events > 0 THEN 1 ELSE 0 END), 9) AS collided, round(avg(command_count), 9) AS commands, round(avg(episode_return), 9) AS mean_return FROM diagnostics GROUP BY 1", "diagnostics"))
def noise_baseline_summary(spark, folder):
    mean = lambda x, name: F.round(F.avg(x), 9).alias(name)
    return A.diagnostics(spark, folder).groupBy(F.regexp_extract("scenario", "^[0-9]{2}", 0).alias("prefix")).agg(
        F.count("*").alias("n"), mean("safe_success", "safe"), mean("arrival", "arrival"), mean((c("collision_events") > 0).cast("int"), "collided"),
        mean("command_count", "commands"), mean("episode_return", "mean_return"),
    )


@query("separation_sweep_summary", O.with_views("SELECT separation_horizontal_km, count(*) AS n, round(100 * avg(safe_success), 6) AS safe_pct, round(avg(CASE WHEN min_contact_horizontal_km >= 0 THEN min_contact_horizontal_km END), 6) AS mean_min_km, min(CASE WHEN min_contact_horizontal_km >= 0 THEN min_contact_horizontal_km END) AS worst_km FROM diagnostics GROUP BY 1", "diagnostics"))
def separation_sweep_summary(spark, folder):
    known = F.when(c("min_contact_horizontal_km") >= 0, c("min_contact_horizontal_km"))
    return A.diagnostics(spark, folder).groupBy("separation_horizontal_km").agg(
        F.count("*").alias("n"), F.round(100 * F.avg("safe_success"), 6).alias("safe_pct"), F.round(F.avg(known), 6).alias("mean_min_km"), F.min(known).alias("worst_km")
    )


@query("stress_summary", O.with_views("SELECT scenario, count(*) AS runs, count_if(safe_success = 1) AS passed, count_if(safe_success <> 1) AS failed, sum(safety_violations) AS losses, max(collision_events) AS most_collisions, round(avg(command_count), 9) AS mean_commands FROM diagnostics GROUP BY 1", "diagnostics"))
def stress_summary(spark, folder):
    return A.diagnostics(spark, folder).groupBy("scenario").agg(
        F.count("*").alias("runs"), F.count_if(c("safe_success") == 1).alias("passed"), F.count_if(c("safe_success") != 1).alias("failed"),
        F.sum(F.coalesce("safety_violations", F.lit(0.0))).alias("losses"), F.max("collision_events").alias("most_collisions"), F.round(F.avg("command_count"), 9).alias("mean_commands"),
    )


@query("safe_success", O.with_views("SELECT row_id, arrival = 1 AND collision_events = 0 AND safety_violations = 0 AND (command_count = 0 OR episode_return >= command_count) AS safe FROM diagnostics", "diagnostics"))
def safe_success(spark, folder):
    """Arrived, without collision or violation, and no more conflicts found than resolved."""
    safe = (c("arrival") == 1) & (c("collision_events") == 0) & (c("safety_violations") == 0) & ((c("command_count") == 0) | (c("episode_return") >= c("command_count")))
    return A.diagnostics(spark, folder).select("row_id", safe.alias("safe"))


@query("run_summary", O.with_views("SELECT episode, count(*) AS events, count_if(event = 'action_executed') AS executed, count_if(event = 'command_failed') AS failed, min(horizontal_km) AS least_km, round(max(sim_time_s) - min(sim_time_s), 6) AS span_s FROM run_events GROUP BY 1", "run_events"))
def run_summary(spark, folder):
    return A.run_events(spark, folder).groupBy("episode").agg(
        F.count("*").alias("events"), F.count_if(c("event") == "action_executed").alias("executed"), F.count_if(c("event") == "command_failed").alias("failed"),
        F.min("horizontal_km").alias("least_km"), F.round(F.max("sim_time_s") - F.min("sim_time_s"), 6).alias("span_s"),
    )


@query("replay_summary", O.with_views("SELECT family, count(*) AS n, round(avg(target), 6) AS mean_target, round(median(target), 6) AS median_target, list_sort(list(target))[CAST(floor((count(*) - 1) * 0.9) AS INT) + 1] AS p90_target FROM sys GROUP BY 1", "sys"))
def replay_summary(spark, folder):
    """Counts and the spread of targets by family; the median is the mean of the middle two, p90 the element at
    floor(0.9 (n - 1)). Ranks are exact: equal targets are counted, and counts added up by ranges of targets."""
    own = A.system_commands(spark, folder)
    v = value_counts(own, "family", "target")
    last = c("of") - 1
    middle = [F.max(F.when(at_rank(place), c("target"))) for place in (F.floor(last / 2), F.ceil(last / 2))]
    spread = v.groupBy("family").agg(
        (F.sum(c("target") * c("n")) / F.sum("n")).alias("mean"), ((middle[0] + middle[1]) / 2).alias("median"), F.max(F.when(at_rank(F.floor(last * 0.9)), c("target"))).alias("p90_target")
    )
    n = own.groupBy(c("family").alias("__family")).agg(F.count("*").alias("n"))
    joined = n.join(spread, c("__family").eqNullSafe(c("family")), "left")
    return joined.select(c("__family").alias("family"), "n", F.round("mean", 6).alias("mean_target"), F.round("median", 6).alias("median_target"), "p90_target")


@query("zero_failure_bound", O.with_views("SELECT scenario, round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / count(*)), 9) AS upper_bound FROM diagnostics GROUP BY 1", "diagnostics"))
def zero_failure_bound(spark, folder):
    """The upper 95% bound of a failure rate that no run out of n showed."""
    return A.diagnostics(spark, folder).groupBy("scenario").agg(F.round(1 - F.pow(F.lit(0.05), 1.0 / F.count("*")), 9).alias("upper_bound"))


@query("usage_daily", "SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY 1")
def usage_daily(spark, folder):
    return table(spark, folder, "lineitem").groupBy(c("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("calls"), F.sum("l_quantity").cast("long").alias("tokens"))


@query("rejection_counts", "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'unsafe' ELSE p_type END AS reason, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def rejection_counts(spark, folder):
    reason = F.when(c("p_partkey") % 4 != 0, c("p_type"))
    return table(spark, folder, "part").where(c("p_size") > 25).groupBy(F.coalesce(reason, F.lit("unsafe")).alias("reason")).agg(F.count("*").alias("n"))
