"""Series of labels: the cases whose results are known by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest

from netpanel.operators import labels as lab

SCHEMA = "entity long, period long, label int"


def table(spark, *series):
    return spark.createDataFrame([(e, t, v) for e, s in enumerate(series) for t, v in enumerate(s)], SCHEMA)


def by_hand(series, min_run):
    """The confirmed series and events, walking over the runs."""
    runs, t = [], 0
    while t < len(series):
        n = 1
        while t + n < len(series) and series[t + n] == series[t]:
            n += 1
        runs.append((t, n, series[t]))
        t += n
    good = [k for k, r in enumerate(runs) if r[1] >= min_run]
    first = good[0] if good else max(range(len(runs)), key=lambda k: (runs[k][1], -k))
    now = runs[first][2]
    out, events = [now] * len(series), []
    for start, n, value in runs[first + 1 :]:
        if value == now:
            continue
        if n >= min_run:
            out[start:] = [value] * (len(series) - start)
            events.append(("confirmed", now, value, start, start + min_run - 1))
            now = value
        elif start + n == len(series):
            events.append(("candidate", now, value, start, None))
    return out, events


def test_confirmed_changes_equal_the_walk(spark):
    r = random.Random(11)
    series = [[r.choice((0, 1, 2)) if r.random() < 0.4 else 0 for _ in range(14)] for _ in range(150)]
    series += [[0] * 5 + [1] + [0] * 6, [0] * 6 + [2] * 6, [0] * 10 + [3] * 2, [0, 1, 1, 1, 2, 2, 1, 1, 1, 1], [0, 1] * 5]
    rows = table(spark, *series)
    want = {e: by_hand(s, 3) for e, s in enumerate(series)}
    got = {}
    for x in lab.confirmed_changes(rows).collect():
        got.setdefault(x.entity, []).append((x.kind, x.from_label, x.to_label, x.period, x.known_at))
    assert {e: sorted(v, key=lambda q: q[3]) for e, v in got.items()} == {e: ev for e, (_, ev) in want.items() if ev}
    found = {}
    for x in lab.confirmed_series(rows).collect():
        found.setdefault(x.entity, {})[x.period] = x.confirmed
    assert all([found[e][t] for t in range(len(s))] == s for e, (s, _) in want.items())


def test_confidence_can_refuse_a_change(spark):
    rows = spark.createDataFrame([(0, t, 0 if t < 5 else 1, 0.9 if t < 5 else c) for t, c in zip(range(10), [0.9] * 5 + [0.1, 0.2, 0.9, 0.9, 0.9], strict=True)], SCHEMA + ", sure double")
    assert [x.kind for x in lab.confirmed_changes(rows, 3, "sure", 0.7).collect()] == ["candidate"]
    assert [x.kind for x in lab.confirmed_changes(rows, 3).collect()] == ["confirmed"]


def test_decomposition_adds_up(spark):
    series = [[0] * 24 for _ in range(200)]
    for s in series[:50]:
        s[12] = 1
    for s in series[50:80]:
        s[5:] = [2] * 19
    found = {x.period: x for x in lab.change_decomposition(table(spark, *series)).collect()}
    total = found[None]
    assert (total.n_raw, total.n_confirmed) == (130, 30)
    assert total.n_raw == total.n_confirmed + total.n_noise_short + total.n_noise_return + total.n_candidate
    assert (found[12].n_raw, found[12].n_noise_short) == (50, 50)


def test_lifecycle(spark):
    one, three, merged = [0] * 30, [0] * 30 + [1] * 30 + [2] * 30, [0] * 60 + [2] * 30
    del one
    kinds = lambda a, b: sorted((x.kind, tuple(x.from_ids), tuple(x.to_ids)) for x in lab.lifecycle(table(spark, *zip(a, b, strict=True))).collect())
    assert kinds(three, merged) == [("continue", (2,), (2,)), ("merge", (0, 1), (0,))]
    assert kinds(merged, three) == [("continue", (2,), (2,)), ("split", (0,), (0, 1))]
    assert [k for k, _, _ in kinds(three, [v + 5 for v in three])] == ["continue"] * 3


def test_births_and_deaths(spark):
    a, b = [0] * 10 + [1] * 2, [0] * 8 + [7] * 2 + [8, 9]
    found = {(x.kind, tuple(x.from_ids) + tuple(x.to_ids)) for x in lab.lifecycle(table(spark, *zip(a, b, strict=True)), 0.6).collect()}
    assert found == {("continue", (0, 0)), ("death", (1,)), ("birth", (7,)), ("birth", (8,)), ("birth", (9,))}


def test_mobility_of_known_matrices(spark):
    still = table(spark, *[[k] * 6 for k in range(3)])
    assert lab.shorrocks(lab.transitions(still)).first().mobility == 0
    even = table(spark, *[[a, b] for a in range(3) for b in range(3)])
    assert abs(lab.shorrocks(lab.transitions(even)).first().mobility - 1) < 1e-12
    assert lab.shorrocks(lab.transitions(table(spark, [0, 0]))).first().mobility is None


def test_trajectories(spark):
    found = {x.entity: x for x in lab.trajectories(table(spark, [0] * 6, [0, 0, 0, 2, 2, 2], [0, 0, 1, 1, 3, 3])).collect()}
    assert [found[e].n_changes for e in range(3)] == [0, 1, 2] and found[2].trajectory == "0,0,1,1,3,3" and found[2].last_change == 4


def test_modal_label_prefers_the_last(spark):
    found = {x.entity: (x.label, x.share) for x in lab.modal_label(table(spark, [1, 1, 2, 2], [2, 2, 1, 1], [-1, 5, 5, 6])).collect()}
    assert found == {0: (2, 0.5), 1: (1, 0.5), 2: (5, 2 / 3)}


def test_assignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(1)
    for n, m in ((3, 3), (4, 2), (2, 5), (5, 5), (1, 1)):
        for _ in range(20):
            s = r.random((n, m))
            found = lab.assignment(s)
            assert len(found) == min(n, m) == len({a for a, _ in found}) == len({b for _, b in found})
            small = s if n <= m else s.T
            best = max(sum(small[i, p[i]] for i in range(min(n, m))) for p in permutations(range(max(n, m)), min(n, m)))
            assert abs(sum(s[a, b] for a, b in found) - best) < 1e-9


def test_alignment_recovers_names_and_gives_fresh_ones(spark):
    assert lab.alignment([(0, 2, 30), (1, 0, 30), (2, 1, 30)]) == {2: 0, 0: 1, 1: 2}
    assert lab.alignment([(0, 0, 16), (0, 5, 14), (1, 1, 30), (2, 2, 30)])[5] == 3
    base = [0] * 30 + [1] * 30 + [2] * 30
    rows = table(spark, *zip(base, [(v + 1) % 3 for v in base], [(v + 2) % 3 for v in base], strict=True))
    assert all(x.aligned == base[x.entity] for x in lab.align_sequence(rows).collect())


@pytest.mark.parametrize("labels", [[5, -3, 7, 5], [0, 0, 0, 0]])
def test_encoded(spark, labels):
    rows = spark.createDataFrame([(k, 0, v) for k, v in enumerate(labels)], SCHEMA)
    order = sorted(set(labels))
    assert {x.entity: x.label for x in lab.encoded(rows).collect()} == {k: order.index(v) for k, v in enumerate(labels)}
