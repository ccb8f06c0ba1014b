"""Boost pickups: two queues matched one to one."""

import random

import numpy as np

from kairoframe.operators import pickups as B


def plain(rows, band=3):
    """Partners by looking at every earlier row that is still alone."""
    alone, partner = [], {}
    for frame, id_, source, kind in rows:
        near = [(frame - f, n, i) for n, (f, i, s, k) in enumerate(alone) if s != source and frame - f <= band and (k == kind or -1 in (k, kind))]
        if near:
            _, n, taken = min(near)
            alone.pop(n)
            partner[id_] = taken
        else:
            alone.append((frame, id_, source, kind))
    return [partner.get(r[1], -1) for r in rows]


def test_two_queues_in_shares_against_plain_search():
    for seed in range(300):
        r = random.Random(seed)
        frames = sorted(r.randrange(60) for _ in range(r.randint(1, 50)))
        rows = [(f, i, r.randrange(2), r.choice([-1, 0, 0, 1])) for i, f in enumerate(frames)]
        columns = [np.array(c) for c in zip(*rows)]
        cuts = [0, *sorted(r.randrange(len(rows) + 1) for _ in range(3)), len(rows)]
        state, got = None, []
        for a, b in zip(cuts, cuts[1:]):
            state, _, (partner,) = B.two_queues(3)(state, [c[a:b] for c in columns])
            got += partner.tolist()
        assert got == plain(rows), seed


def found(spark, reports, jumps):
    a = spark.createDataFrame([(1, p, f, k) for p, f, k in reports], "match_id long, player_id long, frame long, kind int")
    b = spark.createDataFrame([(1, p, f, k, before, 0.0, y, t) for p, f, k, before, y, t in jumps], "match_id long, player_id long, frame long, kind int, before double, after double, y double, team int")
    return sorted(tuple(r) for r in B.boost_pickups(a, b).select("player_id", "frame", "kind", "detection", "collected", "overfill", "is_steal").collect())


def test_outcomes_and_amounts(spark):
    reports = [(1, 10, 1), (1, 30, 0), (2, 10, 0), (1, 50, 1), (1, 51, 1)]
    jumps = [(1, 12, -1, 55.0, 900.0, 0), (1, 34, 0, 0.0, -900.0, 0), (2, 10, 1, 0.0, 5.0, 1), (1, 53, 1, 200.0, -5.0, 1)]
    assert found(spark, reports, jumps) == [
        (1, 12, 1, "both", 200.0, 55.0, True),  # an unknown kind takes the report's
        (1, 30, 0, "reported_only", None, None, None),  # four frames are too far
        (1, 34, 0, "inferred_only", 30.6, 0.0, False),
        (1, 50, 1, "reported_only", None, None, None),
        (1, 53, 1, "both", 55.0, 200.0, True),  # the nearer of two reports
        (2, 10, 0, "reported_only", None, None, None),  # kinds that do not fit
        (2, 10, 1, "inferred_only", 255.0, 0.0, False),
    ]
    assert found(spark, [], []) == []
