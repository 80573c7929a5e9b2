"""Grouped resolution on literal groups, and stateful streaming steps against a plain fold."""

from __future__ import annotations

import itertools

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.operators import resolve as R
from skyledger.operators.more_queries import chains


def group(allowed):
    rows = [(0, 0, p, q, [a for a, _ in ab], [b for _, b in ab]) for (p, q), ab in allowed.items()]
    return pd.DataFrame(rows, columns=["tick", "component", "id1", "id2", "a", "b"])


ACTION = st.tuples(st.integers(0, 2), st.integers(0, 2))


@given(st.fixed_dictionaries({pair: st.sets(ACTION, max_size=5).map(sorted) for pair in [(1, 2), (2, 3), (1, 3)]}))
@settings(max_examples=100, deadline=None)
def test_actions_are_compatible_whenever_they_can_be(allowed):
    found = dict(R.solve(group(allowed))[["trajectory_id", "action"]].itertuples(index=False))
    works = [x for x in itertools.product(range(3), repeat=3) if all((x[p - 1], x[q - 1]) in ab for (p, q), ab in allowed.items())]
    if works:
        assert tuple(found[i] for i in (1, 2, 3)) in works
    else:
        assert set(found.values()) == {-1}


def test_neighbours_get_different_levels():
    edges = pd.DataFrame([(0, 0, a, b) for a, b in [(1, 2), (2, 3), (1, 3), (3, 4)]], columns=["tick", "component", "id1", "id2"])
    level = dict(R.colour(edges)[["trajectory_id", "level_m"]].itertuples(index=False))
    assert all(abs(level[a] - level[b]) >= 600 for a, b in edges[["id1", "id2"]].itertuples(index=False))
    assert level[3] == min(level.values())


def test_chains_use_each_leg_once():
    legs = pd.DataFrame({"airway": 1, "a": [1, 2, 4, 7, 8, 9], "b": [2, 3, 5, 8, 9, 7]})
    out = chains(legs)
    paths = [g.sort_values("place").wpt.tolist() for _, g in out.groupby("chain")]
    used = sorted(tuple(sorted(x)) for p in paths for x in itertools.pairwise(p))
    assert used == sorted(tuple(sorted(x)) for x in zip(legs.a, legs.b))
    assert [1, 2, 3] in paths and [4, 5] in paths and len(paths) == 3


def test_text_sources(spark, tmp_path):
    from skyledger.sources import ingest as I

    (tmp_path / "a.scn").write_text("# comment line\n00:00:05.50>CRE KL1,B738,52,4\nshort\n00:00:01>SCEN one\n00:00:02.00>ALT KL1,FL100\n")
    got = [(r["line"], r["t"], r["command"]) for r in I.scenario_commands(I.text_lines(spark, str(tmp_path))).orderBy("line").collect()]
    assert got == [(2, 5.5, "CRE KL1,B738,52,4"), (4, 1.0, "SCEN one"), (5, 2.0, "ALT KL1,FL100")]
    split = I.split_scenarios(I.scenario_commands(I.text_lines(spark, str(tmp_path)))).collect()
    assert [(r["scenario"], r["command"]) for r in split] == [("one", "ALT KL1,FL100")]
    assert I.manifest(spark, str(tmp_path)).first()["name"] == "a.scn"
    good, bad = I.json_objects(spark.createDataFrame([("f", 1, '{"a": 1}'), ("f", 2, " "), ("f", 3, "[1]"), ("f", 4, "{bad")], "file string, line long, value string"), "a int")
    assert [r["a"] for r in good.collect()] == [1] and [r["line"] for r in bad.orderBy("line").collect()] == [3, 4]
    frames = spark.createDataFrame([("p", bytes.fromhex("1a33" + "00" * 7 + "8d4840d6202cc371c32ce0576098" + "1a32" + "11" * 7 + "5d4840d6aabbcc" + "1a31ff"))], "path string, content binary")
    assert [r["message"] for r in I.modes_frames(frames).orderBy("pos").collect()] == ["8D4840D6202CC371C32CE0576098", "5D4840D6AABBCC"]


def plain_levels(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level = {}
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        taken = [level[j] for j in near[i] if j in level]
        free = [x for x in R.L.LEVELS_M if all(abs(x - t) >= 600 for t in taken)]
        level[i] = float(free[0] if free else max(R.L.LEVELS_M, key=lambda x: (min(abs(x - t) for t in taken), -x)))
    return level


def test_levels_of_crowded_groups_are_those_of_a_plain_walk():
    import random

    random.seed(3)
    for n, share in ((6, 0.5), (40, 0.3), (60, 0.9)):
        edges = [(i * 7, j * 7) for i in range(n) for j in range(i + 1, n) if random.random() < share]
        rows = pd.DataFrame([(0, 0, *e) for e in edges + edges[:3]], columns=["tick", "component", "id1", "id2"])
        assert dict(R.colour(rows)[["trajectory_id", "level_m"]].itertuples(index=False)) == plain_levels(edges)


def test_a_large_group_is_searched_in_time_that_follows_its_links():
    import time

    # a long chain and, at the end by number, a pair that no two actions fit: the search turns back until the trials run out
    n = 4000
    allowed = {(i, i + 1): [(0, 1), (1, 0), (2, 2)] for i in range(0, n, 2)}
    began = time.monotonic()
    found = R.solve(group(allowed))
    assert time.monotonic() - began < 10 and dict(found.groupby("action").size()) == {0: n // 2, 1: n // 2}


def plainly(rows, cap):
    """The search written out: the place with the fewest actions left that fit those chosen, actions in order, each one a trial."""
    ids = sorted(set(rows.id1) | set(rows.id2))
    fits = {}
    for r in rows.itertuples():
        for x, y in zip(r.a, r.b):
            fits.setdefault((r.id1, r.id2), set()).add((x, y))
            fits.setdefault((r.id2, r.id1), set()).add((y, x))
        fits.setdefault((r.id1, r.id2), set()), fits.setdefault((r.id2, r.id1), set())
    chosen, trials = {}, 0

    def left(i):
        near = [j for j in ids if (j, i) in fits]
        ever = {j: {y for _, y in fits[j, i]} for j in near}
        return [x for x in range(5) if all(x in ever[j] and (j not in chosen or (chosen[j], x) in fits[j, i]) for j in near)]

    def step():
        nonlocal trials
        i = min((k for k in ids if k not in chosen), key=lambda k: (len(left(k)), k))
        for x in left(i):
            if trials >= cap:
                return None
            trials += 1
            chosen[i] = x
            if len(chosen) == len(ids):
                return True
            found = step()
            if found is not False:
                return found
            del chosen[i]
        return False if trials < cap or not chosen else None

    found = step()
    return [(i, chosen[i] if found else R.UNDECIDED if found is None else R.NO_SOLUTION) for i in ids]


def test_a_group_is_searched_in_the_same_order(monkeypatch):
    """By lists of actions or by bits of a number, also where trials run out."""
    import numpy as np

    rng, seen = np.random.default_rng(5), set()
    for k in range(60):
        ids, rows = rng.permutation(100)[: rng.integers(2, 9)].tolist(), []
        for p, q in itertools.combinations(sorted(ids), 2):
            if rng.random() < 0.7:
                fits = rng.random((5, 5)) < rng.choice([0.3, 0.5, 0.8])
                rows.append((0, 0, p, q, *map(list, np.nonzero(fits)), int(fits.ravel() @ (1 << np.arange(25)))))
        if not rows:
            continue
        table, cap = pd.DataFrame(rows, columns=["tick", "component", "id1", "id2", "a", "b", "fits"]), int(rng.choice([4, 1000]))
        monkeypatch.setattr(R, "NODE_CAP", cap)
        want = plainly(table, cap)
        for columns in (["a", "b"], ["fits"]):
            got = R.solve(table.drop(columns=columns))
            assert list(got[["trajectory_id", "action"]].itertuples(index=False, name=None)) == want, k
        seen.add(min(want[0][1], 0))
    assert seen == {0, R.NO_SOLUTION, R.UNDECIDED}


def test_actions_of_close_pairs_by_blocks(spark, monkeypatch):
    """As folded pair by pair, the lesser id first, with nothing for what is not known."""
    import numpy as np
    from pyspark.sql import functions as F

    from skyledger.operators import blocks as B
    from skyledger.operators import pairs as P
    from skyledger.operators import resolve_blocks as V

    rng = np.random.default_rng(2)
    made = [(k % 2, int(i), 30 + rng.random() / 5, 104 + rng.random() / 5, 9000.0 + 300 * (k % 3), 200.0 + k, float(k * 37 % 360), float(k % 3 - 1)) for k, i in enumerate(rng.permutation(50))]
    made += [(0, 90, 30.1, 104.1, None, 200.0, 0.0, 0.0), (0, 91, 30.1, 104.1, 9000.0, None, 0.0, 0.0), (0, 92, 30.1, 104.1, 9000.0, 200.0, 0.0, None)]
    states = spark.createDataFrame(made, "tick long, trajectory_id long, lat double, lon double, alt_m double, gs_mps double, trk_deg double, vs_mps double")
    close = P.pairs_within(states, 6.0).where(F.abs(F.col("alt1") - F.col("alt2")) < 700)
    names = ("tick", "id1", "id2", "a", "b")
    want = sorted(map(tuple, R.compatible_actions(close).select(*names).collect()))
    for size in (7, 4096):
        monkeypatch.setattr(B, "BLOCK_ROWS", size)
        monkeypatch.setattr(V, "HELD_PAIRS", size)
        assert sorted(map(tuple, V.action_rows(states, 6.0, 700.0).select(*names).collect())) == want and len(want) > 1000
        assert sorted(map(tuple, V.close_rows(states, 6.0, 700.0).collect())) == sorted(map(tuple, close.select("tick", "id1", "id2").collect()))
        fits = {r[:3]: r[3] for r in map(tuple, V.fit_rows(states, 6.0, 700.0).collect())}
        assert sorted((*p, a, b) for p, f in fits.items() for a in range(5) for b in range(5) if f >> a * 5 + b & 1) == want and len(fits) == close.count()
