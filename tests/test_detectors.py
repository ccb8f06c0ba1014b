import pytest

from kairoframe.operators import detectors as D

FRAME = "match_id string, frame long, t double, dt double, live boolean, ball_x double, ball_y double, ball_z double, ball_vx double, ball_vy double, ball_vz double"
PLAYER = "match_id string, frame long, t double, dt double, live boolean, player_id string, team int, x double, y double, z double, vx double, vy double, vz double, powerslide boolean, dodging boolean, up_z double"
TOUCH = "match_id string, frame long, t double, player_id string, team int, x double, y double, z double"


@pytest.fixture(scope="module")
def make(spark):
    def frames(rows, dt=0.1):
        base = {"x": 0.0, "y": 0.0, "z": 100.0, "vx": 0.0, "vy": 0.0, "vz": 0.0, "live": True}
        out = [(base | r) for r in rows]
        return spark.createDataFrame([("m", i, i * dt, dt, r["live"], r["x"], r["y"], r["z"], r["vx"], r["vy"], r["vz"]) for i, r in enumerate(out)], FRAME)

    def players(rows, dt=0.1):
        base = {"p": "a", "team": 0, "x": 0.0, "y": 0.0, "z": 17.0, "vx": 0.0, "vy": 0.0, "vz": 0.0, "slide": False, "dodge": False, "up": 1.0, "live": True}
        out = [(base | r) for r in rows]
        return spark.createDataFrame([("m", r["f"], r["f"] * dt, dt, r["live"], r["p"], r["team"], *(float(r[c]) for c in ("x", "y", "z", "vx", "vy", "vz")), r["slide"], r["dodge"], r["up"]) for r in out], PLAYER)

    def touches(rows):
        return spark.createDataFrame([("m", f, f * 0.1, p, team, float(x), float(y), float(z)) for f, p, team, x, y, z in rows], TOUCH)

    return frames, players, touches


def test_counters_and_goals(spark):
    df = spark.createDataFrame([("m", "a", 1, 2), ("m", "a", 2, 2), ("m", "a", 3, 4)], "match_id string, player_id string, frame long, v long")
    assert [r.number for r in D.increments(df, D.PLAYER, ["frame"], "v", True).orderBy("number").collect()] == [1, 2, 3, 4]
    assert [r.number for r in D.increments(df, D.PLAYER, ["frame"], "v", False).orderBy("number").collect()] == [3, 4]
    goals = spark.createDataFrame([("m", 1.0, 1, 0, 1, 0), ("m", 9.0, 2, 0, 1, 0), ("m", 10.0, 3, 1, None, None), ("m", 12.9, 4, 1, None, None), ("m", 16.0, 5, 1, None, None)], "match_id string, t double, frame long, team int, score0 int, score1 int")
    assert [r.frame for r in D.distinct_goals(goals).orderBy("frame").collect()] == [1, 3, 5]
    # The window runs from the last goal kept, not from the last one seen.
    often = goals.sparkSession.createDataFrame([("m", t, i, 1, None, None) for i, t in enumerate((0.0, 2.0, 3.0, 4.0, 7.1))], goals.schema)
    assert [r.t for r in D.distinct_goals(often).orderBy("t").collect()] == [0.0, 4.0, 7.1]
    pairs = spark.createDataFrame([("m", f, "a", "b") for f in (1, 2, 9, 17, 26)], "match_id string, frame long, attacker string, victim string")
    assert [r.frame for r in D.demolitions(pairs).orderBy("frame").collect()] == [1, 26]


def test_sticky_values_end_with_the_actor(spark):
    rows = [("m", 1, 1, "x", False), ("m", 1, 2, None, False), ("m", 1, 3, None, True), ("m", 1, 4, None, False), ("m", 1, 5, "y", False)]
    df = spark.createDataFrame(rows, "match_id string, actor long, frame long, v string, deleted boolean")
    assert [r.v for r in D.sticky(df, ["match_id", "actor"], ["frame"], "v").orderBy("frame").collect()] == ["x", "x", None, None, "y"]


def test_phases(spark):
    rows = [(True, False, False), (False, False, False), (False, False, True), (False, True, True), (False, False, True), (True, False, False), (False, False, None)]
    df = spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], "match_id string, frame long, kickoff boolean, goal boolean, hit boolean")
    assert [r.phase for r in D.live_play(df).orderBy("frame").collect()] == ["kickoff_countdown", "kickoff_waiting", "active", "post_goal", "post_goal", "kickoff_countdown", "unknown"]


def test_ball_spans(make):
    frames, _, _ = make
    df = frames([{"y": -3000.0}, {"y": -250.0}, {"y": 0.0}, {"y": 0.0, "live": False}, {"y": 2300.0}])
    assert [r.state for r in D.ball_half(df).orderBy("island").collect()] == ["team0_half", "neutral", None, "team1_half"]
    assert [r.state for r in D.ball_third(df).orderBy("island").collect()] == ["team0_third", "middle", None, "team1_third"]


def test_movement_powerslide_and_roles(make):
    _, players, _ = make
    df = players([{"f": i, "x": 100.0 * i, "vx": 1000.0 if i < 3 else 2300.0, "slide": i in (1, 2)} for i in range(5)])
    got = D.movement(df).orderBy("start_frame").collect()
    assert [(r.state, r.distance, round(r.duration, 6), round(r.mean_speed, 6)) for r in got] == [("slow/ground", 200.0, 0.3, 1000.0), ("supersonic/ground", 200.0, 0.2, 2300.0)]
    assert [(r.start, r.n_samples) for r in D.powerslides(df).collect()] == [(0.1, 2)]
    team = players([{"f": 0, "p": p, "team": t, "y": y} for p, t, y in (("a", 1, 900.0), ("b", 1, 0.0), ("c", 1, -900.0), ("d", 0, 5.0))])
    assert {r.player_id: r.depth_role for r in D.depth_roles(team).collect()} == {"a": "most_back", "b": "mid", "c": "most_forward", "d": "no_teammates"}


def test_thirds_are_split_where_they_are_crossed(make):
    _, players, _ = make
    df = players([{"f": 0, "y": 2200.0}, {"f": 1, "y": 2600.0}])
    assert {r.third: round(r.seconds, 6) for r in D.field_thirds(df).collect()} == {"neutral": 0.025, "offensive": 0.075}


def test_carry_and_first_man(make):
    frames, players, _ = make
    balls = frames([{"z": 150.0} for _ in range(15)])
    cars = players([{"f": i, "p": p, "x": x} for i in range(15) for p, x in (("a", 50.0), ("b", 900.0))])
    assert [(r.player_id, round(r.end - r.start, 6)) for r in D.ball_carries(cars, balls).collect()] == [("a", 1.4)]
    assert {(r.player_id, r.ball_rank) for r in D.distance_rank(cars, balls).collect()} == {("a", 1), ("b", 2)}


def test_passes_one_timers_and_chains(make):
    frames, _, touches = make
    t = touches([(0, "a", 0, 0, 0, 0), (35, "b", 0, 0, 600, 0), (70, "a", 0, 0, 1000, 0), (80, "c", 1, 0, 4000, 0), (85, "c", 1, 0, 0, 0), (95, "c", 1, 0, 0, 0)])
    assert [(r.passer, r.receiver) for r in D.passes(t).collect()] == [("a", "b")]
    assert [(r.player_id, r.n_touches) for r in D.controlled_plays(t).collect()] == [("c", 3)]
    shot = frames([{"y": 600.0, "vy": 1500.0} for _ in range(36)])
    assert [(r.passer, r.receiver) for r in D.one_timers(t, shot).collect()] == [("a", "b")]
    assert D.one_timers(t, frames([{"y": 600.0, "vy": -1500.0} for _ in range(36)])).count() == 0


def test_center_and_backboard(make):
    frames, _, touches = make
    t = touches([(0, "a", 0, 2000, 3000, 0)])
    balls = frames([{"x": 2000.0 - 100 * i, "y": 3000.0} for i in range(12)])
    assert [(r.player_id, r.resolved_frame) for r in D.centers(t, balls).collect()] == [("a", 6)]
    assert D.centers(touches([(0, "a", 0, 2000, 3000, 0), (3, "b", 1, 0, 0, 0)]), balls).count() == 0
    wall = frames([{"y": 4800.0, "z": 900.0, "vy": 1000.0}, {"y": 4900.0, "z": 900.0, "vy": 900.0}, {"y": 4800.0, "z": 900.0, "vy": -600.0}])
    assert [(r.frame, r.player_id) for r in D.backboard_bounces(wall, t).collect()] == [(2, "a")]


def test_wavedash_and_goal_tags(make, spark):
    _, players, _ = make
    df = players([{"f": 0, "z": 60.0, "vx": 800.0}, {"f": 1, "z": 60.0, "vx": 800.0, "dodge": True}, {"f": 2, "z": 17.0, "vx": 1400.0, "dodge": True}])
    assert [round(r.confidence, 3) > 0.8 for r in D.wavedashes(df).collect()] == [True]
    goals = spark.createDataFrame([("m", 10, 10.0, 1, 5.0, 100.0, 700.0), ("m", 90, 90.0, 0, 80.0, 2000.0, 50.0)], "match_id string, frame long, t double, team int, touch_t double, touch_y double, touch_z double")
    assert [r.tags for r in D.goal_tags(goals).orderBy("frame").collect()] == [["aerial", "long_distance", "own_half"], []]
    mechanics = spark.createDataFrame([("m", 1, 8.0), ("m", 0, 88.0)], "match_id string, team int, t double")
    theirs = spark.createDataFrame([("m", 1, 89.0)], "match_id string, team int, t double")
    assert [(r.frame, r.tag) for r in D.tagged_by_mechanic(goals, mechanics, theirs, 3.0, "flick").collect()] == [(10, "flick")]
