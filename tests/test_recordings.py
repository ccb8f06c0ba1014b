"""The operators on recordings on small cases made by hand; the queries over generated recordings are held against SQL in test_catalogue.py."""

import pytest
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import derive as V
from kairoframe.operators import mechanics as M

TOUCH = "match_id long, frame long, t double, touch_id long, player_id long, team int, x double, y double, z double"


def touches(spark, rows):
    """rows: frame, player, team, x, y, z."""
    return spark.createDataFrame([(1, f, f / 10, f, p, team, float(x), float(y), float(z)) for f, p, team, x, y, z in rows], TOUCH)


def ball(spark, rows):
    """rows: frame, x, y, z, vx, vy, vz."""
    return spark.createDataFrame([(1, f, f / 10, 0.1, *map(float, r)) for f, *r in rows], "match_id long, frame long, t double, dt double, ball_x double, ball_y double, ball_z double, ball_vx double, ball_vy double, ball_vz double")


def bodies(spark, rows):
    """rows: frame, player, team, x, y, z, vx, vy, dodging."""
    return spark.createDataFrame([(1, f, f / 10, 0.1, p, team, *map(float, r), 0.0, d) for f, p, team, *r, d in rows], "match_id long, frame long, t double, dt double, player_id long, team int, x double, y double, z double, vx double, vy double, vz double, dodging boolean")


@pytest.mark.parametrize("end,winner", [((0, 500), 0), ((0, -500), 1), ((0, 50), None)])
def test_fifty_fifty_is_won_by_where_the_ball_goes(spark, end, winner):
    tc = touches(spark, [(10, 1, 0, 0, 0, 93), (11, 2, 1, 0, 0, 93), (40, 1, 0, 0, 0, 93)])
    pl = bodies(spark, [(11, 1, 0, 0, -100, 17, 0, 0, False), (11, 2, 1, 0, 100, 17, 0, 0, False)])
    fr = ball(spark, [(f, *end, 93, 0, 0, 0) for f in range(10, 20)])
    got = M.fifty_fifties(tc, fr, pl).collect()
    assert [(r.frame, r.p0, r.p1, r.resolved_frame, r.winner) for r in got] == [(11, 1, 2, 15, winner)]


def test_rush_needs_attackers_defenders_and_time(spark):
    pl = bodies(spark, [(20, 1, 0, 0, -1100, 17, 0, 0, False), (20, 3, 0, 0, -1500, 17, 0, 0, False), (20, 2, 1, 0, 900, 17, 0, 0, False)])
    rows = [(10, 2, 1, 0, -1000, 93), (20, 1, 0, 0, -1000, 93)]
    assert [(r.frame, r.attackers, r.defenders) for r in M.rushes(touches(spark, rows), pl).collect()] == [(20, 2, 1)]
    assert M.rushes(touches(spark, [*rows, (25, 2, 1, 0, 0, 93)]), pl).collect() == []  # lost after half a second
    assert M.rushes(touches(spark, [rows[0], (20, 1, 0, 0, 500, 93)]), pl).collect() == []  # not in the own half


def test_double_tap_is_the_next_touch_of_the_same_player_on_net(spark):
    bounces = spark.createDataFrame([(1, 10, 1.0, 7)], "match_id long, frame long, t double, player_id long")
    fr = ball(spark, [(f, 0, 3000, 300, 0, 2000, 100) for f in range(30)])
    assert [r.frame for r in M.double_taps(bounces, touches(spark, [(5, 7, 0, 0, 3000, 300), (15, 7, 0, 0, 3000, 300), (20, 7, 0, 0, 3000, 300)]), fr).collect()] == [15]
    assert M.double_taps(bounces, touches(spark, [(12, 8, 0, 0, 3000, 300), (15, 7, 0, 0, 3000, 300)]), fr).collect() == []


def test_bump_has_an_initiator_and_is_seen_once(spark):
    rows = []
    for f in range(4):  # player 1 drives into player 2, who is pushed on
        rows.append((f, 1, 0, -400 + 150 * f, 0, 17, 1500 if f < 3 else 700, 0, False))
        rows.append((f, 2, 1, 0 if f < 3 else 90, 0, 17, 0 if f < 3 else 900, 0, False))
    none = spark.createDataFrame([], "match_id long, t double, p0 long, p1 long")
    got = M.bumps(bodies(spark, rows), none).collect()
    assert [(r.frame, r.player_id, r.victim) for r in got] == [(3, 1, 2)]
    held = spark.createDataFrame([(1, 0.3, 1, 2)], "match_id long, t double, p0 long, p1 long")
    assert M.bumps(bodies(spark, rows), held).collect() == []


def test_swept_gap_sees_what_passes_between_two_samples(spark):
    df = spark.createDataFrame([(100.0, 0.0, 0.0, -100.0, 0.0, 0.0, -100.0, 0.0, 0.0, 100.0, 0.0, 0.0)], ", ".join(f"{n} double" for n in ("ax", "ay", "az", "p_ax", "p_ay", "p_az", "ox", "oy", "oz", "p_ox", "p_oy", "p_oz")))
    assert M.swept_gap(df).first().swept == 0


def test_dodge_direction(spark):
    rows = [(0, 1, 0, 0, 0, 17, 100, 0, False), (1, 1, 0, 0, 0, 17, 100, 0, True), (2, 1, 0, 0, 0, 17, 600, 0, True), (3, 1, 0, 0, 0, 17, 600, 0, True)]
    assert [(r.frame, r.delta, r.direction) for r in M.dodges(bodies(spark, rows)).collect()] == [(1, 500.0, "forward")]


def test_boost_is_filled_down_with_use_and_never_below_zero(spark):
    rows = [(1, 1, 0, 0.1, None, False, True), (1, 1, 1, 0.1, None, True, False), (1, 1, 2, 2.0, None, True, False), (1, 1, 3, 0.1, 50.0, True, False), (1, 1, 4, 0.1, None, False, False), (1, 1, 5, 0.1, None, True, False)]
    df = spark.createDataFrame(rows, "match_id long, player_id long, frame long, dt double, raw double, active boolean, kickoff boolean")
    assert [round(r.amount, 3) for r in V.boost_amounts(df).orderBy("frame").collect()] == [85.0, 76.398, 0.0, 50.0, 50.0, 41.398]


def test_pickups_scorers_and_identities(spark):
    pads = spark.createDataFrame([(1, 3, 0, t, int(10 * t)) for t in (0.0, 3.9, 7.9, 12.0)], "match_id long, pad_id long, sequence int, t double, frame long")
    assert [r.t for r in V.pad_pickups(pads).orderBy("t").collect()] == [0.0, 7.9, 12.0]
    goals = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (1, 7, 1)], "match_id long, frame long, team int")
    who = "match_id long, frame long, team int, player_id long"
    exploded, counted = spark.createDataFrame([(1, 5, 0, 2), (1, 6, 0, 4)], who), spark.createDataFrame([(1, 5, 0, 4), (1, 6, 1, 3), (1, 6, 1, 1)], who)
    assert [(r.frame, r.scorer, r.source) for r in V.goal_scorers(goals, exploded, counted).orderBy("frame").collect()] == [(5, 2, "explosion"), (6, 1, "counter"), (7, None, "none")]
    seen = spark.createDataFrame([(1, 9, 10.0, 0.0), (1, 9, 20.0, 5.0), (1, 9, 900.0, 0.0)], "match_id long, pad_id long, x double, y double")
    assert [(r.place, r.votes) for r in V.pad_identities(seen, [(0, 0.0, 0.0, False), (1, 1000.0, 0.0, False)]).collect()] == [(0, 2)]


def test_merged_spans_trailing_runs_and_late_joiners(spark):
    spans = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.5, 4.0), ("a", 7.0, 8.0), ("a", 3.0, 3.5)], "k string, start double, end double")
    assert [(r.start, r.end, r.n_parts) for r in M.merged_spans(spans, ["k"], 2.0).orderBy("start").collect()] == [(0.0, 4.0, 3), (7.0, 8.0, 1)]
    samples = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False)], "k string, i long, ok boolean")
    assert [(r.k, r.n, r.since) for r in M.trailing_run(samples, ["k"], ["i"], F.col("ok")).orderBy("k").collect()] == [("a", 2, 3), ("b", 0, None)]
    snapshot = spark.createDataFrame([("a", 5, "old"), ("b", 5, "kept")], "k string, at long, v string")
    history = spark.createDataFrame([("a", 4, "older"), ("a", 9, "new"), ("c", 7, "added")], "k string, at long, v string")
    assert [(r.k, r.v, r["at"]) for r in M.caught_up(snapshot, history, ["k"], "at", "v", 5).orderBy("k").collect()] == [("a", "new", 9), ("b", "kept", 5), ("c", "added", 7)]


def test_functions_of_space(spark):
    lit = lambda *xs: tuple(F.lit(float(x)) for x in xs)
    quarter = C.axis_angle(lit(0, 0, 1), F.lit(3.141592653589793 / 2))
    row = spark.range(1).select(
        C.angle_between(quarter, lit(0, 0, 0, 1)).alias("angle"), C.segment_distance(lit(5, 4), lit(0, 0), lit(3, 0)).alias("far"), C.box_distance(lit(0, 5, 0), lit(0, 0, 0), quarter, (3.0, 1.0, 1.0)).alias("box"),
        C.box_distance(lit(0.5, 0, 0), lit(0, 0, 0), lit(0, 0, 0, 1), (1.0, 1.0, 1.0)).alias("inside"), C.title_case(F.lit("ball_third")).alias("title"), C.without_prefix(F.lit("ball_third"), "ball_").alias("short"), C.boost_raw(C.boost_percent(F.lit(51.0))).alias("raw"),
    ).first()
    assert abs(row.angle - 1.5707963) < 1e-6 and abs(row.far - 20**0.5) < 1e-9 and abs(row.box - 2) < 1e-9 and row.inside == 0
    assert (row.title, row.short, row.raw) == ("Ball Third", "third", 51.0)


def test_changes_published_by_micro_batches_replay_to_the_last_table(spark, tmp_path):
    from kairoframe.streaming import live

    tables = [[("a", 1), ("b", 2)], [("a", 1), ("c", 3)], [("a", 5)]]
    for number, rows in enumerate(tables):
        for _ in range(2):  # a micro-batch that runs again writes the same
            live.publish(spark.createDataFrame(rows, "k string, v long"), number, str(tmp_path), ["k"], ["v"])
    changes = spark.read.parquet(str(tmp_path / "changes"))
    assert sorted((r.seq, r.change, r.k, r.v) for r in changes.collect()) == [(0, "upsert", "a", 1), (0, "upsert", "b", 2), (1, "retract", "b", None), (1, "upsert", "c", 3), (2, "retract", "c", None), (2, "upsert", "a", 5)]
    assert [tuple(r) for r in live.replayed(changes, ["k"]).select("k", "v").collect()] == [("a", 5)]


def test_nearest_row_of_a_dimension_that_travels_in_parts(spark):
    from kairoframe.operators import matching

    rows = spark.createDataFrame([(i, [float(i % 13), float(i % 7)]) for i in range(60)], "id long, x array<double>")
    dimension = spark.createDataFrame([(n, [float(n % 5), float(n // 5)]) for n in range(25)], "name int, centre array<double>")
    whole, parts = (sorted(tuple(r) for r in matching.nearest(rows, "x", dimension, "name", "centre", most=m).collect()) for m in (10_000, 4))
    assert whole == parts
    assert all(d == min((x[0] - n % 5) ** 2 + (x[1] - n // 5) ** 2 for n in range(25)) for _, x, _, d in whole)
