"""Event detectors on match recordings, composed of the temporal operators.

Tables (positions in uu, times in seconds; team 0 attacks +y):
  frames(match_id, frame, t, dt, live, ball_x, ball_y, ball_z, ball_vx, ball_vy, ball_vz)
  players(match_id, frame, t, dt, live, player_id, team, x, y, z, vx, vy, vz, powerslide, dodging)
  touches(match_id, frame, t, player_id, team, x, y, z), of the ball at the touch

Everything is partitioned by match, so that one shuffle by match_id serves any number of detectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import matching, scans, temporal

# Fixed values of the game's rules and of the detectors.
HALF_DEADZONE, THIRD_BOUNDARY, DEPTH_BOUNDARY, ROLE_SPREAD = 200.0, 2300.0, 150.0, 236.0
SUPERSONIC, BOOST_SPEED, GROUND_Z, HIGH_Z, POWERSLIDE_Z = 2200.0, 1410.0, 20.0, 735.525, 40.0
CARRY_LOW, CARRY_HIGH, CARRY_GAP, CARRY_RISE, CARRY_TIME = 97.75, 600.0, 129.85, 220.0, 1.0
PASS_TIME, PASS_TRAVEL, ONE_TIMER_SPEED, ONE_TIMER_COSINE = 3.5, 500.0, 1000.0, 0.65
BOARD_AGE, BOARD_Z, BOARD_Y, BOARD_APPROACH, BOARD_REBOUND = 2.5, 500.0, 4700.0, 350.0, -250.0
CENTER_TIME, CENTER_WIDE, CENTER_INSIDE, CENTER_SHIFT, CENTER_FROM, CENTER_TO = 3.0, 1600.0, 1400.0, 500.0, 128.0, 2300.0
CHAIN_GAP, CHAIN_TIME = 2.5, 1.0
GOAL_LINE, GOAL_HALF_WIDTH, GOAL_HEIGHT = 5120.0, 892.755, 642.775
DEMO_FRAMES, BUMP_FRAMES, GOAL_REPEAT = 8, 10, 3.0

MATCH, PLAYER = ["match_id"], ["match_id", "player_id"]


def normalised_y(y: Column, team: Column) -> Column:
    """y as the team sees it: its own goal is at -y."""
    return F.when(team == 0, y).otherwise(-y)


# --- changes of replicated values -> events


def sticky(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Every change row with the last value known by then (deleted actors' rows carry null and a true ``deleted``, which resets it)."""
    lives = temporal.segment(changes, keys, order, F.col("deleted"), "life")
    w = temporal.running([*keys, "life"], order)
    return lives.withColumn(value, F.last(value, ignorenulls=True).over(w)).drop("life")


def increments(counters: DataFrame, keys: list[str], order: list[str], counter: str, first_counts: bool) -> DataFrame:
    """One row for each step that a counter rises by, with ``number``, its value then. The first value counts from 0 or, if not first_counts,
    only sets the baseline."""
    before = F.lag(counter).over(temporal.ordered(keys, order))
    staged = counters.withColumn("__before", F.coalesce(before, F.lit(0) if first_counts else F.col(counter))).where(F.col(counter) > F.col("__before"))
    return staged.withColumn("number", F.explode(F.sequence(F.col("__before") + 1, F.col(counter)))).drop("__before")


def _accepted_goals(last, columns):
    """A scan: which goals are no repeat of the last accepted one. A share of rows is a match's goals, a handful, so it goes through them one by one."""
    kept = []
    for i, (ms, _, team, zero, one) in enumerate(zip(*(c.tolist() for c in columns))):
        if last is not None:
            known = min(zero, one, last[2], last[3]) >= 0
            if (zero, one) == last[2:] if known else team == last[1] and ms - last[0] <= GOAL_REPEAT * 1000:
                continue
        last = (ms, team, zero, one)
        kept.append(i)
    return last, np.array(kept, np.int64), []


def distinct_goals(goals: DataFrame) -> DataFrame:
    """goals(match_id, t, frame, team, score0, score1): without repeats of the last goal kept: of its score, or, where either's is not known, of its team within 3 s."""
    numbered = goals.withColumn("__n", F.row_number().over(temporal.ordered(MATCH, ["t", "frame", "team", "score0", "score1"])).cast("long"))
    rows = numbered.select("match_id", F.round(F.col("t") * 1000).cast("long").alias("ms"), "__n", "team", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("score0", "score1")))
    kept = scans.scanned(rows, MATCH, ["ms", "__n"], ["team", "score0", "score1"], _accepted_goals, f"match_id {goals.schema['match_id'].dataType.simpleString()}, ms long, __n long")
    return numbered.join(kept.select("match_id", "__n"), ["match_id", "__n"], "left_semi").select(*goals.columns)


def demolitions(pairs: DataFrame) -> DataFrame:
    """pairs(match_id, frame, attacker, victim), one row for every frame that a pair is seen: one event a sighting after a pause."""
    return temporal.sightings_apart(pairs, ["match_id", "attacker", "victim"], ["frame"], "frame", DEMO_FRAMES)


# --- phases and spans


def live_play(frames: DataFrame) -> DataFrame:
    """frames with kickoff (countdown running), goal (scored in this frame), hit (the ball was hit since the kickoff): adds ``phase``.
    A goal's aftermath lasts until the next kickoff."""
    w = temporal.running(MATCH, ["frame"])
    mark = F.when(F.col("goal"), 1).when(F.col("kickoff"), 0)
    after_goal = F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)) == 1
    phase = F.when(F.col("kickoff"), "kickoff_countdown").when(after_goal, "post_goal").when(F.col("hit").isNull(), "unknown").when(~F.col("hit"), "kickoff_waiting").otherwise("active")
    return frames.withColumn("phase", phase)


def _live_state(state: Column) -> Column:
    return F.when(F.col("live"), state)


def ball_half(frames: DataFrame) -> DataFrame:
    """Spans of the ball in a half, with a neutral zone about the middle; stoppages are spans of no state."""
    state = C.band(F.col("ball_y"), [(-HALF_DEADZONE, "team0_half"), (HALF_DEADZONE, "neutral")], "team1_half")
    return temporal.spans(frames, MATCH, ["frame"], "t", _live_state(state))


def ball_third(frames: DataFrame) -> DataFrame:
    state = C.band(F.col("ball_y"), [(-THIRD_BOUNDARY, "team0_third"), (THIRD_BOUNDARY, "middle")], "team1_third")
    return temporal.spans(frames, MATCH, ["frame"], "t", _live_state(state))


def speed_band(speed: Column) -> Column:
    return C.band(speed, [(BOOST_SPEED, "slow"), (SUPERSONIC, "boost")], "supersonic")


def height_band(z: Column) -> Column:
    return F.when(z <= GROUND_Z, "ground").when(z >= HIGH_Z, "high_air").when(z.isNotNull(), "low_air")


def movement(players: DataFrame) -> DataFrame:
    """Spans of equal speed and height band per player, with distance and time-weighted mean speed."""
    speed = C.length((F.col("vx"), F.col("vy"), F.col("vz")))
    w = temporal.ordered(PLAYER, ["frame"])
    step = C.length(tuple(F.col(c) - F.lag(c).over(w) for c in "xyz"))
    rows = players.withColumn("speed", speed).withColumn("__step", F.when(F.col("live"), F.coalesce(step, F.lit(0.0))).otherwise(0.0))
    rows = temporal.islands(rows, PLAYER, ["frame"], _live_state(F.concat_ws("/", speed_band(F.col("speed")), height_band(F.col("z")))))
    spans = rows.groupBy(*PLAYER, "island").agg(
        F.first("state").alias("state"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        F.sum("dt").alias("duration"), F.sum("__step").alias("distance"), F.sum(F.col("speed") * F.col("dt")).alias("__sd"),
    )
    return spans.where("state IS NOT NULL").withColumn("mean_speed", C.safe_ratio(F.col("__sd"), F.col("duration"))).drop("__sd")


def powerslides(players: DataFrame) -> DataFrame:
    on = F.coalesce(F.col("powerslide"), F.lit(False)) & (F.col("z") <= POWERSLIDE_Z)
    return temporal.spans(players, PLAYER, ["frame"], "t", on).where("state").drop("state")


def field_thirds(players: DataFrame) -> DataFrame:
    """Seconds per player in each third of the field as the team sees it; steps that cross a boundary are split where they cross it."""
    rows = players.where("live").withColumn("ny", normalised_y(F.col("y"), F.col("team")))
    cut = temporal.crossings(rows, PLAYER, ["frame"], "ny", [-THIRD_BOUNDARY, THIRD_BOUNDARY])
    named = F.element_at(F.array(*map(F.lit, ("defensive", "neutral", "offensive"))), F.col("region") + 1)
    return cut.groupBy(*PLAYER, named.alias("third")).agg(F.sum(F.col("dt") * F.col("share")).alias("seconds"))


def field_regions(players: DataFrame, name: str) -> DataFrame:
    """The same for the two halves of the field, in the column ``name``."""
    rows = players.where("live").withColumn("ny", normalised_y(F.col("y"), F.col("team")))
    cut = temporal.crossings(rows, PLAYER, ["frame"], "ny", [0])
    return cut.groupBy(*PLAYER, F.when(F.col("region") == 0, "defensive").otherwise("offensive").alias(name)).agg(F.sum(F.col("dt") * F.col("share")).alias("seconds"))


def ball_depths(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Seconds per player behind, level with and ahead of the ball, as the team sees it."""
    rows = players.where("live").join(frames.select("match_id", "frame", "ball_y"), ["match_id", "frame"])
    rows = rows.withColumn("ny", normalised_y(F.col("y"), F.col("team")) - normalised_y(F.col("ball_y"), F.col("team")))
    cut = temporal.crossings(rows, PLAYER, ["frame"], "ny", [-DEPTH_BOUNDARY, DEPTH_BOUNDARY])
    named = F.element_at(F.array(*map(F.lit, ("behind", "level", "ahead"))), F.col("region") + 1)
    return cut.groupBy(*PLAYER, named.alias("depth")).agg(F.sum(F.col("dt") * F.col("share")).alias("seconds"))


def depth_roles(players: DataFrame) -> DataFrame:
    rows = players.where("live").withColumn("ny", normalised_y(F.col("y"), F.col("team")))
    named = temporal.roles(rows, ["match_id", "frame", "team"], "ny", "player_id", ROLE_SPREAD)
    state = F.when(F.col("role") == "alone", "no_teammates").when(F.col("role") == "back", "most_back").when(F.col("role") == "front", "most_forward").when((F.col("members") == 3) & (F.col("spread") >= ROLE_SPREAD), "mid").otherwise("other")
    return named.withColumn("depth_role", state).drop("role", "ny", "members", "spread")


def distance_rank(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Each player's place in the team by horizontal distance to the ball (1: first man), and that distance."""
    joined = players.join(frames.select("match_id", "frame", "ball_x", "ball_y"), ["match_id", "frame"])
    near = joined.withColumn("ball_distance", C.length((F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y"))))
    return temporal.ranked(near, ["match_id", "frame", "team"], [F.col("ball_distance"), F.col("player_id")], "ball_rank")


def ball_carries(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Stretches of at least a second in which the ball stays on top of one player."""
    joined = players.join(frames.select("match_id", "frame", "ball_x", "ball_y", "ball_z"), ["match_id", "frame"])
    flat = C.length((F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y")))
    carried = F.col("live") & F.col("ball_z").between(CARRY_LOW, CARRY_HIGH) & (flat <= CARRY_GAP) & (F.abs(F.col("ball_z") - F.col("z")) <= CARRY_RISE)
    return temporal.spans(joined, PLAYER, ["frame"], "t", F.coalesce(carried, F.lit(False))).where(F.col("state") & (F.col("end") - F.col("start") >= CARRY_TIME)).drop("state")


# --- touches and what follows them


def with_previous_touch(touches: DataFrame) -> DataFrame:
    return temporal.with_previous(touches, MATCH, ["t", "frame", "player_id"], ["t", "player_id", "team", "x", "y", "z"])


def passes(touches: DataFrame, previous_time: bool = False) -> DataFrame:
    """A touch after one by a team-mate within 3.5 s (both ends included), if the ball has travelled 500; with previous_time, the passer's touch as prev_t."""
    travel = C.length(tuple(F.col(c) - F.col(f"prev_{c}") for c in "xyz"))
    age = F.col("t") - F.col("prev_t")
    rows = with_previous_touch(touches).withColumn("travel", travel)
    return rows.where((F.col("team") == F.col("prev_team")) & (F.col("player_id") != F.col("prev_player_id")) & age.between(0, PASS_TIME) & (F.col("travel") >= PASS_TRAVEL)).select(
        *MATCH, "frame", "t", "team", F.col("prev_player_id").alias("passer"), F.col("player_id").alias("receiver"), "travel", *(["prev_t"] if previous_time else [])
    )


def on_net(p: C.Vector, v: C.Vector, team: Column) -> Column:
    """Whether a straight line from p along v meets the goal mouth that the team attacks."""
    side = F.when(team == 0, GOAL_LINE).otherwise(-GOAL_LINE)
    time = (side - p[1]) / F.nullif(v[1], F.lit(0.0))
    x, z = p[0] + v[0] * time, p[2] + v[2] * time
    return F.coalesce((v[1] != 0) & (time >= 0) & (F.abs(x) <= GOAL_HALF_WIDTH) & z.between(0, GOAL_HEIGHT), F.lit(False))


def one_timers(touches: DataFrame, frames: DataFrame) -> DataFrame:
    """Passes whose receiving touch sends the ball on net, fast and towards the goal."""
    balls = frames.select("match_id", "frame", "ball_x", "ball_y", "ball_z", "ball_vx", "ball_vy", "ball_vz")
    rows = passes(touches).join(balls, ["match_id", "frame"])
    p, v = (F.col("ball_x"), F.col("ball_y"), F.col("ball_z")), (F.col("ball_vx"), F.col("ball_vy"), F.col("ball_vz"))
    goal = (F.lit(0.0), F.when(F.col("team") == 0, GOAL_LINE).otherwise(-GOAL_LINE), F.lit(GOAL_HEIGHT / 2))
    cosine = C.dot(C.normalised(v), C.normalised(C.subtract(goal, p)))
    return rows.where((C.length(v) >= ONE_TIMER_SPEED) & (cosine >= ONE_TIMER_COSINE) & on_net(p, v, F.col("team"))).select("match_id", "frame", "t", "team", "passer", "receiver")


def backboard_bounces(frames: DataFrame, touches: DataFrame) -> DataFrame:
    """Frames in which the ball comes off a back wall high up, credited to the last touch of at most 2.5 s before."""
    moved = temporal.with_previous(frames, MATCH, ["frame"], ["ball_vy"]).where("live")
    last = matching.as_of(moved, touches.withColumnRenamed("player_id", "by").withColumnRenamed("team", "by_team"), MATCH, "t", "frame", ["by", "by_team", "t"])
    team = F.col("last_by_team")
    towards, away = normalised_y(F.col("prev_ball_vy"), team), normalised_y(F.col("ball_vy"), team)
    high = (F.col("ball_z") >= BOARD_Z) & (normalised_y(F.col("ball_y"), team) >= BOARD_Y)
    return last.where(high & (towards >= BOARD_APPROACH) & (away <= BOARD_REBOUND) & (F.col("t") - F.col("last_t") <= BOARD_AGE)).select("match_id", "frame", "t", F.col("last_by").alias("player_id"), team.alias("team"))


def centers(touches: DataFrame, frames: DataFrame) -> DataFrame:
    """Touches from the side after which the ball comes inside, up the field, within 3 s and before the next touch; with the first such frame."""
    w = temporal.ordered(MATCH, ["t", "frame", "player_id"])
    wide = touches.withColumn("until", F.least(F.coalesce(F.lead("t").over(w), F.col("t") + CENTER_TIME), F.col("t") + CENTER_TIME))
    wide = wide.where((F.abs(F.col("x")) >= CENTER_WIDE) & (normalised_y(F.col("y"), F.col("team")) >= CENTER_FROM))
    balls = frames.where("live").select("match_id", F.col("frame").alias("seen_frame"), F.col("t").alias("seen"), "ball_x", "ball_y")
    pairs = matching.in_window(wide, balls, MATCH, "t", "seen", 0, CENTER_TIME).where("seen <= until")
    inside = (F.abs(F.col("ball_x")) <= CENTER_INSIDE) & (F.abs(F.col("x")) - F.abs(F.col("ball_x")) >= CENTER_SHIFT) & (normalised_y(F.col("ball_y"), F.col("team")) >= CENTER_TO)
    return pairs.where(inside).groupBy("match_id", "frame", "t", "player_id", "team").agg(F.min("seen_frame").alias("resolved_frame"))


def controlled_plays(touches: DataFrame) -> DataFrame:
    """Two or more touches running by one player, each within 2.5 s of the one before, over at least a second."""
    chained = temporal.chains(touches, MATCH, ["t", "frame"], "t", "player_id", CHAIN_GAP)
    found = chained.groupBy("match_id", "episode").agg(F.first("player_id").alias("player_id"), F.first("team").alias("team"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n_touches"))
    return found.where((F.col("n_touches") >= 2) & (F.col("end") - F.col("start") >= CHAIN_TIME)).drop("episode")


def wavedashes(players: DataFrame) -> DataFrame:
    """Dodges begun close above the ground that land upright within 0.35 s; confidence is a weighted sum of scores. players also has up_z, the
    vertical part of the car's up direction."""
    dodges = temporal.rising_edges(players, PLAYER, ["frame"], F.col("dodging")).where(F.col("z").between(28, 320))
    dodges = dodges.select("match_id", "player_id", "team", "frame", "t", F.col("z").alias("z0"), C.length((F.col("vx"), F.col("vy"))).alias("v0"))
    landed = players.where((F.col("z") <= GROUND_Z) & (F.col("up_z") >= 0.15)).select("match_id", "player_id", F.col("t").alias("landed"), "up_z", C.length((F.col("vx"), F.col("vy"))).alias("v1"))
    pairs = matching.in_window(dodges, landed, PLAYER, "t", "landed", 0, 0.35)
    first = Window.partitionBy(*PLAYER, "frame").orderBy("landed")
    rows = pairs.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    wait, gain = F.col("landed") - F.col("t"), F.col("v1") - F.col("v0")
    confidence = (
        (F.lit(1.0) - C.unit_score(wait, 0.08, 0.35)) * 0.35
        + (F.lit(1.0) - C.unit_score(F.col("z0"), 28, 220)) * 0.25
        + F.greatest(C.unit_score(gain, 80, 550), C.unit_score(F.col("v1"), 900, 1800) * 0.8) * 0.25
        + C.unit_score(F.col("up_z"), 0.3, 0.95) * 0.15
    )
    return rows.withColumn("confidence", confidence).where("confidence >= 0.45")


def goal_tags(goals: DataFrame) -> DataFrame:
    """goals(match_id, frame, t, team, touch_t, touch_y, touch_z) with ``tags``, those that the scoring touch alone decides."""
    ny = normalised_y(F.col("touch_y"), F.col("team"))
    tags = F.array(
        F.when(F.col("touch_z") >= 600, "aerial"),
        F.when(ny <= 1024, "long_distance"),
        F.when((ny <= 0) & (F.col("t") - F.col("touch_t") <= 8), "own_half"),
    )
    return goals.withColumn("tags", F.array_compact(tags))


def tagged_by_mechanic(goals: DataFrame, mechanics: DataFrame, opposing: DataFrame, within: float, name: str) -> DataFrame:
    """Goals with a mechanic of the scoring team's player up to ``within`` seconds before and no opposing touch in between; mechanics and opposing
    touches carry (match_id, team, t)."""
    seen = mechanics.select("match_id", "team", F.col("t").alias("done"))
    pairs = matching.in_window(seen, goals.select("match_id", "team", F.col("t").alias("scored"), F.col("frame").alias("goal_frame")), ["match_id", "team"], "done", "scored", 0, within)
    last = pairs.groupBy("match_id", "team", "goal_frame", "scored").agg(F.max("done").alias("done"))
    theirs = opposing.withColumn("team", 1 - F.col("team"))
    clear = matching.unbroken(last.withColumn("a", (F.col("done") * 1000).cast("long")).withColumn("b", (F.col("scored") * 1000).cast("long")), theirs.withColumn("ms", (F.col("t") * 1000).cast("long")), ["match_id", "team"], "a", "b", "ms")
    return clear.select("match_id", "team", F.col("goal_frame").alias("frame"), F.lit(name).alias("tag"))
