"""Plans and scenes of a store, and flags of training episodes, on literal cases."""

from __future__ import annotations

from skyledger.operators.more_queries import training_alerts
from skyledger.operators.policy_queries import marked, resolved, saved_plans


def test_a_saved_plan_replaces_the_old_one_and_resolves_its_scene(spark):
    plans = lambda *rows: spark.createDataFrame(rows, "fingerprint string, turn long, proposal string")
    store = saved_plans(saved_plans(None, plans(("a", 1, "p1"), ("a", 2, "p2"), ("b", 1, "p3"), (None, 1, "p4"))), plans(("b", 0, "p5"), ("c", 9, "p6")))
    assert sorted(map(tuple, store.collect())) == [("a", "p2", "prediction_validated"), ("b", "p5", "prediction_validated"), ("c", "p6", "prediction_validated")]
    queue = spark.createDataFrame([("a", "pending", ""), ("d", "failed", "why"), ("b", "failed", "no way")], "fingerprint string, status string, reason string")
    done = resolved(queue, store)
    assert sorted(map(tuple, done.collect())) == [("a", "resolved", ""), ("b", "resolved", "no way"), ("d", "failed", "why")]
    marks = spark.createDataFrame([("a", 1, "failed", "again"), ("x", 1, "failed", "")], "fingerprint string, turn long, status string, reason string")
    assert sorted(map(tuple, marked(done, marks).collect()))[0] == ("a", "failed", "again")
    assert saved_plans(None, plans(("a", 1, "p")).limit(0)).count() == 0


def test_alerts(spark):
    rows = [(1, True, 0.05, 30, 0, 50.0, 6.0, 3.0, 3), (2, True, None, 19, 0, None, 1.0, 1.0, 0), (3, False, 0.0, 20, 1, 99.0, 0.0, 0.0, 1), (4, None, 0.0, 20, 0, 99.0, 2.0, 2.0, 2)]
    schema = "row_id int, update_performed boolean, discrete_entropy double, available_headings int, headings int, critic_loss double, mean_sum double, std_sum double, samples int"
    got = training_alerts(spark.createDataFrame(rows, schema)).select("row_id", "collapsed", "starved", "diverging", "parameter_mean", "parameter_std").collect()
    assert list(map(tuple, got)) == [(1, True, True, True, 2.0, 1.0), (2, True, False, False, 1.0, 1.0), (3, False, False, False, 0.0, 0.0), (4, False, True, False, 1.0, 1.0)]
