"""Detectors of touches, contests, mechanics and goals, composed of the temporal operators on the tables of sources/recordings.py.

Times are seconds, positions uu; team 0 attacks +y. Everything is partitioned by match; joins in time are equi-joins on time cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import matching, temporal
from kairoframe.operators.detectors import GOAL_HALF_WIDTH, GOAL_HEIGHT, GOAL_LINE, normalised_y, on_net
from kairoframe.operators.derive import on_surface

# Fixed values of the game's rules and of the detectors.
GRAVITY, BALL_RADIUS = -650.0, 93.0
CONTROL, HARD = 320.0, 900.0
CLEAR_Y, CLEAR_SPEED, CLEAR_COSINE, BOOM_SPEED, BOOM_COSINE, SHOT_SPEED = -1706.7, 1300.0, 0.2, 1500.0, 0.3, 1000.0
CONTEST, CONTEST_AFTER, EXIT_DISTANCE, EXIT_SPEED = 0.2, 0.35, 180.0, 220.0
RUSH_Y, RUSH_SUPPORT, RUSH_AHEAD, RUSH_RETAINED = -128.0, 900.0, 150.0, 0.75
BOUNCE_TO_TOUCH, VOLLEY_SPEED, BOUNCE_Z, BOUNCE_DOWN, BOUNCE_UP, DODGE_TO_TOUCH = 0.45, 1000.0, BALL_RADIUS + 45.0, 250.0, 150.0, 0.35
IMPULSE_TIME, IMPULSE_LEAST, IMPULSE_SIDE, IMPULSE_UP = 0.18, 10.0, 0.28, 0.45
WHIFF_ENTER, WHIFF_LEAVE = 220.0, 360.0
KICKOFF_AFTER, KICKOFF_NEUTRAL, FIELD = 1.25, 256.0, 5120.0
EMPTY_NET_Y, EMPTY_NET_MARGIN, EMPTY_NET_DISTANCE = 3600.0, 700.0, 1000.0
BUILD_UP, TRAIL = 12.0, 4.0
RESPAWN = 3.2
KICKOFF_GOAL, KICKOFF_CONTEST, KICKOFF_RESET, PLAY_SLACK = 12.0, 0.35, 1280.0, 0.05
AIR_GAP, AIR_TIME, AIR_Z = 3.0, 0.65, 300.0
BUMP_DT, BUMP_GAP, BUMP_CLOSING, BUMP_IMPULSE, BUMP_SCORE, BUMP_MARGIN, BUMP_REACH, BUMP_FRAMES = 0.18, 35.0, 420.0, 180.0, 650.0, 175.0, 118.0, 10
TOUCH_NEAR, TOUCH_FAR, TOUCH_REPEAT = 5.0, 25.0, 0.25

MATCH, PLAYER = ["match_id"], ["match_id", "player_id"]
BALL = ("ball_x", "ball_y", "ball_z")


def xyz(prefix: str) -> C.Vector:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


# --- touches


def touch_candidates(players: DataFrame, frames: DataFrame, reach: float) -> DataFrame:
    """match_id, frame, t, player_id, gap, score: players near a ball that left its free flight, by the rule (gap <= 5 and moved by 25 or changed by
    15) or (gap <= 25 and moved by 500 or changed by 1000); a lower score is a better claim, rank 1 the best of a frame."""
    w = temporal.ordered(MATCH, ["frame"])
    before = {c: F.lag(f"ball_{c}").over(w) for c in ("x", "y", "z", "vx", "vy", "vz")}
    moved = frames.select("match_id", "frame", "t", "dt", *BALL, "ball_vx", "ball_vy", "ball_vz", *(c.alias(f"p_{n}") for n, c in before.items())).where("p_x IS NOT NULL")
    expected = C.free_flight(xyz("p_"), xyz("p_v"), F.col("dt"), GRAVITY)
    off = C.length(C.subtract(xyz("ball_"), expected))
    turned = C.length((F.col("ball_vx") - F.col("p_vx"), F.col("ball_vy") - F.col("p_vy"), F.col("ball_vz") - F.col("p_vz") - F.col("dt") * GRAVITY))
    moved = moved.select("match_id", "frame", *BALL, off.alias("off"), turned.alias("turned"))
    near = players.join(moved, ["match_id", "frame"]).withColumn("gap", F.greatest(F.lit(0.0), C.length(C.subtract(xyz(""), xyz("ball_"))) - reach))
    taken = ((F.col("gap") <= TOUCH_NEAR) & ((F.col("off") >= 25) | (F.col("turned") >= 15))) | ((F.col("gap") <= TOUCH_FAR) & ((F.col("off") >= 500) | (F.col("turned") >= 1000)))
    score = F.col("gap") + F.when(F.col("gap") > TOUCH_NEAR, 100.0).otherwise(0.0) - F.col("dodging").cast("double")
    rows = near.where(taken).select("match_id", "frame", "t", "player_id", "team", "gap", score.alias("score"), "dodging")
    return temporal.ranked(rows, ["match_id", "frame"], touch_order(), "claim")


def touch_order() -> list[Column]:
    """The total order of claims to a touch within a frame: score, gap, dodge first, then the player."""
    return [F.col("score"), F.col("gap"), F.desc("dodging"), F.col("player_id")]


def touch_kinds(touches: DataFrame, frames: DataFrame, players: DataFrame) -> DataFrame:
    """touches with ``kind`` (how much of the ball's change free flight leaves unexplained), ``height``, ``surface`` and ``action``: the first that
    fits of shot, clear, boom."""
    w = temporal.ordered(MATCH, ["frame"])
    flight = frames.select("match_id", "frame", "dt", *BALL, "ball_vx", "ball_vy", "ball_vz", *(F.coalesce(F.lag(f"ball_v{c}").over(w), F.lit(0.0)).alias(f"w{c}") for c in "xyz"))
    body = players.select("match_id", "frame", "player_id", *(F.col(c).alias(f"car_{c}") for c in "xyz"))
    rows = touches.join(flight, ["match_id", "frame"]).join(body, ["match_id", "frame", "player_id"])
    v = xyz("ball_v")
    residual = C.length((v[0] - F.col("wx"), v[1] - F.col("wy"), v[2] - F.col("wz") - F.col("dt") * GRAVITY))
    wall, _, _ = on_surface(*xyz("car_"))
    side = F.when(F.col("team") == 0, GOAL_LINE).otherwise(-GOAL_LINE)
    time = (side - F.col("ball_y")) / F.nullif(v[1], F.lit(0.0))
    x, z = F.col("ball_x") + v[0] * time, F.col("ball_z") + v[2] * time + time * time * (0.5 * GRAVITY)
    speed = C.length(v)
    shot = F.coalesce((v[1] != 0) & (time >= 0) & (speed >= SHOT_SPEED) & (F.abs(x) <= GOAL_HALF_WIDTH) & z.between(0, GOAL_HEIGHT), F.lit(False))
    away = C.dot(C.normalised(v), C.normalised((F.col("ball_x"), F.col("ball_y") + side, F.lit(0.0))))
    goalward = C.dot(C.normalised(v), C.normalised((-F.col("ball_x"), side - F.col("ball_y"), F.lit(0.0))))
    clear = (normalised_y(F.col("ball_y"), F.col("team")) <= CLEAR_Y) & (speed >= CLEAR_SPEED) & (away >= CLEAR_COSINE)
    boom = (speed >= BOOM_SPEED) & (goalward >= BOOM_COSINE)
    return rows.select(
        *touches.columns,
        F.when(residual <= CONTROL, "control").when(residual < HARD, "medium").otherwise("hard").alias("kind"),
        F.when(F.col("car_z") < 100, "ground").otherwise("air").alias("height"),
        F.when(wall, "wall").when(F.col("car_z") <= 20, "ground").otherwise("air").alias("surface"),
        F.when(shot, "shot").when(clear, "clear").when(boom, "boom").otherwise("none").alias("action"),
    )


def joined_on_touch(events: DataFrame, touches: DataFrame) -> DataFrame:
    """Events with their touch (as touch_frame): by touch_id or, where they have none, by the latest touch of the player up to their frame."""
    direct = events.where("touch_id IS NOT NULL").join(touches.select("touch_id", F.col("frame").alias("touch_frame")), "touch_id", "left").select(*events.columns, "touch_frame")
    later = touches.select("match_id", "player_id", "t", F.col("frame").alias("touch_frame"), F.lit(0).alias("tie"))
    rest = matching.as_of(events.where("touch_id IS NULL").withColumn("tie", F.lit(1)), later, PLAYER, "t", "tie", ["touch_frame"])
    return direct.unionByName(rest.select(*events.columns, F.col("last_touch_frame").alias("touch_frame")))


def pass_kinds(passes: DataFrame, bounces: DataFrame, contests: DataFrame) -> DataFrame:
    """passes(match_id, t, prev_t, ...) with ``kind``: wall if the ball came off a board between the two touches, contested if it was contested, else
    direct. bounces, contests: match_id, t."""
    for name, marks in (("wall", bounces), ("contested", contests)):
        early = passes.select("match_id", "frame", F.col("prev_t").alias("from"), F.col("t").alias("to"))
        inside = matching.in_window(early, marks.select("match_id", F.col("t").alias("at")), MATCH, "from", "at", 0, 3.5).where("at > from AND at < to")
        passes = matching.flag_exists(passes, inside, ["match_id", "frame"], f"is_{name}")
    return passes.withColumn("kind", F.when(F.col("is_wall") == 1, "wall").when(F.col("is_contested") == 1, "contested").otherwise("direct")).drop("is_wall", "is_contested")


# --- contests and contacts


def fifty_fifties(touches: DataFrame, frames: DataFrame, players: DataFrame) -> DataFrame:
    """Touches of both teams running, at most 0.2 s apart, resolved at the first frame 0.35 s later: the winner is the team from whose player the ball has
    left the middle by 180 along the line between the two players, or else moves at 220."""
    pairs = temporal.with_previous(touches, MATCH, ["t", "frame"], ["t", "player_id", "team"])
    pairs = pairs.where((F.col("team") != F.col("prev_team")) & (F.col("t") - F.col("prev_t") <= CONTEST))
    sides = [F.when(F.col("team") == i, F.col("player_id")).otherwise(F.col("prev_player_id")).alias(f"p{i}") for i in (0, 1)]
    rows = pairs.select("match_id", "frame", "t", *sides)
    for i in (0, 1):
        rows = rows.join(players.select("match_id", "frame", F.col("player_id").alias(f"p{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")), ["match_id", "frame", f"p{i}"])
    later = frames.select("match_id", F.col("frame").alias("resolved_frame"), F.col("t").alias("later"), "ball_x", "ball_y", "ball_vx", "ball_vy")
    seen = matching.in_window(rows, later, MATCH, "t", "later", CONTEST_AFTER, 1.25)
    first = temporal.ranked(seen, ["match_id", "frame"], [F.col("resolved_frame")], "__n").where("__n = 1").drop("__n")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = C.length((dx, dy))
    nx, ny = F.when(size > 0, dx / size).otherwise(0.0), F.when(size > 0, dy / size).otherwise(1.0)
    s = (F.col("ball_x") - (F.col("x0") + F.col("x1")) / 2) * nx + (F.col("ball_y") - (F.col("y0") + F.col("y1")) / 2) * ny
    v = F.col("ball_vx") * nx + F.col("ball_vy") * ny
    by = F.when(F.abs(s) >= EXIT_DISTANCE, s).when(F.abs(v) >= EXIT_SPEED, v)
    return first.select("match_id", "frame", "t", "p0", "p1", "resolved_frame", F.when(by > 0, 0).when(by <= 0, 1).alias("winner"))


def swept_gap(pairs: DataFrame, samples: int = 9) -> DataFrame:
    """pairs with ax, ay, az, ox, oy, oz now and those of the sample before as p_ax ...: ``swept``, the least distance over evenly spaced moments of the
    step between them."""
    steps = F.sequence(F.lit(0), F.lit(samples - 1))

    def distance(i: Column) -> Column:
        s = i / (samples - 1)
        return C.length(tuple((F.col(f"p_a{c}") + (F.col(f"a{c}") - F.col(f"p_a{c}")) * s) - (F.col(f"p_o{c}") + (F.col(f"o{c}") - F.col(f"p_o{c}")) * s) for c in "xyz"))

    return pairs.withColumn("swept", F.array_min(F.transform(steps, distance)))


def opposing_pairs(players: DataFrame) -> DataFrame:
    """Every frame's pairs of a team-0 player (a) and a team-1 player (b), a few a frame, with their places (ax ..., ox ...), velocities and those of the frame before."""
    w = temporal.ordered(PLAYER, ["frame"])
    moved = players.select("match_id", "frame", "t", "dt", "player_id", "team", *(F.col(c) for c in ("x", "y", "z", "vx", "vy", "vz")), *(F.lag(c).over(w).alias(f"p_{c}") for c in ("x", "y", "z", "vx", "vy", "vz")))
    moved = moved.where("p_x IS NOT NULL")
    sides = []
    for team, s, who in ((0, "a", "a"), (1, "o", "b")):
        named = [F.col(f"{p}{c}").alias(f"{p}{s}{c}") for p in ("", "p_") for c in ("x", "y", "z", "vx", "vy", "vz")]
        sides.append(moved.where(F.col("team") == team).select("match_id", "frame", *(["t", "dt"] if s == "a" else []), F.col("player_id").alias(who), *named))
    return sides[0].join(sides[1], ["match_id", "frame"])


def bumps(players: DataFrame, contests: DataFrame) -> DataFrame:
    """Contacts of opposing players that push one of them: closing speed, the victim's gain and the initiator's loss along the line between them make a
    score for either direction; the higher one is the initiator. Contacts within 0.35 s of a contest of the two do not count; of a pair's sightings
    only the first after 10 frames does."""
    rows = swept_gap(opposing_pairs(players)).withColumn("gap", F.greatest(F.lit(0.0), F.col("swept") - BUMP_REACH))
    n = C.normalised(tuple(F.col(f"o{c}") - F.col(f"a{c}") for c in "xyz"))
    along = {k: C.dot(xyz(k), n) for k in ("av", "ov", "p_av", "p_ov")}
    rows = rows.where((F.col("dt") <= BUMP_DT) & (F.col("gap") <= BUMP_GAP)).select("match_id", "frame", "t", "a", "b", "gap", *(c.alias(k) for k, c in along.items()))
    zero = F.lit(0.0)
    closing = F.col("p_av") - F.col("p_ov")
    gain_b, loss_a = F.col("ov") - F.col("p_ov"), F.col("p_av") - F.col("av")
    gain_a, loss_b = F.col("p_av") - F.col("av"), F.col("ov") - F.col("p_ov")
    score_a = closing + F.greatest(gain_b, zero) * 1.35 + F.greatest(loss_a, zero) * 0.35 + F.when(F.col("p_av") > 0, 220.0).otherwise(0.0)
    score_b = closing + F.greatest(gain_a, zero) * 1.35 + F.greatest(loss_b, zero) * 0.35 + F.when(F.col("p_ov") < 0, 220.0).otherwise(0.0)
    rows = rows.select("match_id", "frame", "t", "a", "b", closing.alias("closing"), F.greatest(gain_a, gain_b).alias("impulse"), score_a.alias("score_a"), score_b.alias("score_b"))
    best, margin = F.greatest("score_a", "score_b"), F.abs(F.col("score_a") - F.col("score_b"))
    pushed = rows.where((F.col("closing") >= BUMP_CLOSING) & (F.col("impulse") >= BUMP_IMPULSE) & (best >= BUMP_SCORE) & (margin >= BUMP_MARGIN))
    pushed = temporal.sightings_apart(pushed, ["match_id", "a", "b"], ["frame"], "frame", BUMP_FRAMES)
    held = contests.select("match_id", F.col("p0").alias("a"), F.col("p1").alias("b"), (F.col("t") - CONTEST_AFTER).alias("from"))
    hidden = matching.in_window(held, pushed.select("match_id", "a", "b", "frame", "t"), ["match_id", "a", "b"], "from", "t", 0, 2 * CONTEST_AFTER)
    first = F.col("score_a") >= F.col("score_b")
    kept = pushed.join(hidden.select("match_id", "a", "b", "frame").distinct(), ["match_id", "a", "b", "frame"], "left_anti")
    return kept.select("match_id", "frame", "t", F.when(first, F.col("a")).otherwise(F.col("b")).alias("player_id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("victim"), F.greatest("score_a", "score_b").alias("score"))


def rushes(touches: DataFrame, players: DataFrame) -> DataFrame:
    """Touches that turn the ball over in the own half, kept for 0.75 s, with at least two attackers not far behind the ball and a defender ahead of it."""
    w = temporal.ordered(MATCH, ["t", "frame"])
    rows = touches.select("match_id", "frame", "t", "team", normalised_y(F.col("y"), F.col("team")).alias("ball_ny"), F.lag("team").over(w).alias("before"))
    later = F.min(F.when(F.col("before") != F.col("team"), F.col("t"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    turned = rows.withColumn("lost", later).where((F.col("before") != F.col("team")) & (F.col("ball_ny") <= RUSH_Y) & (F.col("lost").isNull() | (F.col("lost") - F.col("t") >= RUSH_RETAINED)))
    bodies = players.select("match_id", "frame", F.col("team").alias("side"), "y")
    ny = normalised_y(F.col("y"), F.col("team"))
    attacks = (F.col("side") == F.col("team")) & (ny >= F.col("ball_ny") - RUSH_SUPPORT)
    defends = (F.col("side") != F.col("team")) & (ny >= F.col("ball_ny") + RUSH_AHEAD)
    counted = turned.drop("before", "lost").join(bodies, ["match_id", "frame"]).groupBy("match_id", "frame", "t", "team").agg(F.sum(attacks.cast("long")).alias("attackers"), F.sum(defends.cast("long")).alias("defenders"))
    return counted.where("attackers >= 2 AND defenders >= 1")


def whiffs(near: DataFrame, touches: DataFrame) -> DataFrame:
    """near: spans (match_id, player_id, start, end) in which a player was at the ball (entered below 220, left above 360): those without a touch
    by anyone from their start to their end."""
    rows = matching.in_window(near, touches.select("match_id", F.col("t").alias("at")), MATCH, "start", "at", 0, 1.5).where(F.col("at") <= F.col("end"))
    return near.join(rows.select("match_id", "player_id", "start").distinct(), ["match_id", "player_id", "start"], "left_anti")


# --- mechanics


def dodges(players: DataFrame) -> DataFrame:
    """Beginnings of a dodge with the largest change of velocity within 0.18 s and its direction as seen along the heading."""
    begun = temporal.rising_edges(players, PLAYER, ["frame"], F.col("dodging")).select("match_id", "player_id", "team", "frame", "t", *(F.col(f"v{c}").alias(f"b{c}") for c in "xyz"))
    after = players.select("match_id", "player_id", F.col("t").alias("at"), "vx", "vy", "vz")
    seen = matching.in_window(begun, after, PLAYER, "t", "at", 0, IMPULSE_TIME).withColumn("delta", C.length(tuple(F.col(f"v{c}") - F.col(f"b{c}") for c in "xyz")))
    best = temporal.ranked(seen, [*PLAYER, "frame"], [F.desc("delta"), F.col("at")], "__n").where(F.col("__n") == 1)
    dx, dy, dz = (F.col(f"v{c}") - F.col(f"b{c}") for c in "xyz")
    flat = C.length((F.col("bx"), F.col("by")))
    hx, hy = F.when(flat > 0, F.col("bx") / flat).otherwise(1.0), F.when(flat > 0, F.col("by") / flat).otherwise(0.0)
    ahead, side, up = (dx * hx + dy * hy) / F.col("delta"), (dy * hx - dx * hy) / F.col("delta"), dz / F.col("delta")
    label = F.when(F.abs(ahead) >= IMPULSE_UP, F.when(ahead > 0, "forward").otherwise("backward")).when(F.abs(side) >= IMPULSE_SIDE, F.when(side > 0, "left").otherwise("right")).when(F.abs(up) >= IMPULSE_UP, F.when(up > 0, "up").otherwise("down")).otherwise("neutral")
    return best.where(F.col("delta") >= IMPULSE_LEAST).select("match_id", "player_id", "team", "frame", "t", "delta", label.alias("direction"))


def double_taps(bounces: DataFrame, touches: DataFrame, frames: DataFrame) -> DataFrame:
    """The touch after a bounce off the board, if it is of the player credited with the bounce and sends the ball on net."""
    marks = bounces.select("match_id", "t", "frame", F.col("player_id").alias("by"))
    w = temporal.ordered(MATCH, ["t", "frame"])
    # Only the touch that is next: the bounce lies after the touch before it.
    rows = matching.as_of(touches.withColumn("before", F.lag("t").over(w)), marks, MATCH, "t", "frame", ["by", "t"])
    rows = rows.where((F.col("last_by") == F.col("player_id")) & (F.coalesce("before", F.lit(-1.0)) < F.col("last_t")))
    balls = frames.select("match_id", "frame", *BALL, "ball_vx", "ball_vy", "ball_vz")
    return rows.join(balls, ["match_id", "frame"]).where(on_net(xyz("ball_"), xyz("ball_v"), F.col("team"))).select("match_id", "frame", "t", "player_id", "team", F.col("last_t").alias("bounce_t"))


def half_volleys(touches: DataFrame, frames: DataFrame, dodging: DataFrame) -> DataFrame:
    """Fast touches not long after the ball came off the floor and the player began a dodge."""
    w = temporal.ordered(MATCH, ["frame"])
    floor = frames.select("match_id", "frame", "t", "ball_z", "ball_vz", F.lag("ball_vz").over(w).alias("falling")).where((F.col("ball_z") <= BOUNCE_Z) & (F.col("falling") <= -BOUNCE_DOWN) & (F.col("ball_vz") >= BOUNCE_UP))
    rows = matching.as_of(touches, floor.select("match_id", "t", "frame"), MATCH, "t", "frame", ["t"], BOUNCE_TO_TOUCH).withColumnRenamed("last_t", "bounced")
    begun = dodging.select("match_id", "player_id", "t", "frame")
    rows = matching.as_of(rows.where("bounced IS NOT NULL"), begun, PLAYER, "t", "frame", ["t"], DODGE_TO_TOUCH).withColumnRenamed("last_t", "dodged").where("dodged IS NOT NULL")
    fast = frames.where(C.length(xyz("ball_v")) >= VOLLEY_SPEED).select("match_id", "frame")
    return rows.join(fast, ["match_id", "frame"], "left_semi").select("match_id", "frame", "t", "player_id", "team", "bounced", "dodged")


def air_dribbles(touches: DataFrame, players: DataFrame) -> DataFrame:
    """Runs of touches by one player, 3 s apart at most, of at least three with two in the air and the ball above 300 after the first, over 0.65 s."""
    body = players.select("match_id", "frame", "player_id", F.col("z").alias("car_z"))
    rows = temporal.chains(touches.join(body, ["match_id", "frame", "player_id"]), MATCH, ["t", "frame"], "t", "player_id", AIR_GAP)
    rows = rows.withColumn("number", F.row_number().over(temporal.ordered([*MATCH, "episode"], ["t", "frame"])))
    low = (F.col("number") > 1) & (F.col("z") < AIR_Z)
    found = rows.groupBy("match_id", "episode").agg(F.min("player_id").alias("player_id"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n_touches"), F.sum((F.col("car_z") > 100).cast("long")).alias("n_air"), F.sum(low.cast("long")).alias("n_low"))
    return found.where((F.col("n_touches") >= 3) & (F.col("n_air") >= 2) & (F.col("n_low") == 0) & (F.col("end") - F.col("start") >= AIR_TIME)).drop("episode", "n_low")


def boost_respawns(players: DataFrame, demolitions: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """When players get their boost back: at the first frame of every kickoff, and 3.2 s after a demolition. kickoffs: match_id, frame, t."""
    started = kickoffs.join(players.select("match_id", "frame", "player_id"), ["match_id", "frame"]).select("match_id", "frame", "player_id", F.lit("kickoff").alias("reason"))
    back = demolitions.select("match_id", F.col("victim").alias("player_id"), F.col("frame").alias("down"), "t")
    seen = matching.in_window(back, players.select("match_id", "player_id", "frame", F.col("t").alias("at")), PLAYER, "t", "at", RESPAWN, RESPAWN + 1)
    returned = seen.groupBy("match_id", "player_id", "down").agg(F.min("frame").alias("frame")).select("match_id", "frame", "player_id", F.lit("demolition").alias("reason"))
    return started.unionByName(returned)


# --- kickoffs and goals


def kickoff_starts(phases: DataFrame) -> DataFrame:
    """The first frame of every stretch of kickoff frames: phases(match_id, frame, t, kickoff)."""
    return temporal.rising_edges(phases, MATCH, ["frame"], F.col("kickoff")).select("match_id", "frame", "t")


def kickoffs(starts: DataFrame, touches: DataFrame, frames: DataFrame, players: DataFrame) -> DataFrame:
    """Every kickoff that is touched before the next one: who touched first, the takers (nearest to the middle, by team), the spawn of the first
    toucher, and how the ball stands 1.25 s after the touch: winner, strength and its band."""
    w = temporal.ordered(MATCH, ["frame"])
    begun = starts.select("match_id", F.col("frame").alias("start_frame"), F.col("t").alias("start_t"), F.lead("frame").over(w).alias("next_frame"))
    last = matching.as_of(touches.select("match_id", "frame", "t", "player_id", "team"), begun.withColumn("frame", F.col("start_frame")).withColumn("t", F.col("start_t")), MATCH, "t", "frame", ["start_frame"])
    first = temporal.ranked(last.where("last_start_frame IS NOT NULL"), ["match_id", "last_start_frame"], [F.col("t"), F.col("frame")], "__n").where("__n = 1")
    first = first.select("match_id", F.col("last_start_frame").alias("start_frame"), F.col("frame").alias("touch_frame"), F.col("t").alias("touch_t"), F.col("player_id").alias("toucher"), "team")
    spawned = players.select("match_id", F.col("frame").alias("start_frame"), F.col("player_id").alias("who"), F.col("team").alias("side"), "x", "y", C.length((F.col("x"), F.col("y"))).alias("far"))
    at_start = first.select("match_id", "start_frame").join(spawned, ["match_id", "start_frame"])
    takers = at_start.groupBy("match_id", "start_frame").agg(*(F.min_by(F.when(F.col("side") == i, F.col("who")), F.when(F.col("side") == i, F.struct("far", "who"))).alias(f"taker{i}") for i in (0, 1)))
    ax, ay = F.abs(F.col("x")), F.abs(F.col("y"))
    spawn = F.when((ax <= 350) & (ay >= 4300), "center").when((ax <= 900) & (ay >= 3300), "off_center").when((ax >= 1500) & (ay <= 3300), "diagonal").otherwise("other")
    own = at_start.select("match_id", "start_frame", F.col("who").alias("toucher"), spawn.alias("spawn"))
    later = frames.select("match_id", F.col("frame").alias("resolved_frame"), F.col("t").alias("later"), F.col("ball_y").alias("ry"), F.col("ball_vy").alias("rvy"))
    seen = matching.in_window(first, later, MATCH, "touch_t", "later", KICKOFF_AFTER, KICKOFF_AFTER + 0.75)
    seen = temporal.ranked(seen, ["match_id", "start_frame"], [F.col("resolved_frame")], "__n").where("__n = 1")
    y = F.greatest(F.lit(-FIELD), F.least(F.lit(FIELD), F.col("ry") + F.col("rvy") * 0.5))
    strength = F.abs(y) / FIELD
    band = F.when(F.abs(y) < KICKOFF_NEUTRAL, "neutral").when(strength >= 0.5, "strong").when(strength >= 0.25, "clear").otherwise("narrow")
    judged = seen.select("match_id", "start_frame", "touch_frame", "toucher", "team", "resolved_frame", strength.alias("strength"), band.alias("win"), F.when(F.abs(y) >= KICKOFF_NEUTRAL, (y < 0).cast("int")).alias("winner"))
    return judged.join(takers, ["match_id", "start_frame"]).join(own, ["match_id", "start_frame", "toucher"])


def goal_contexts(goals: DataFrame, touches: DataFrame, players: DataFrame, frames: DataFrame) -> DataFrame:
    """goals with the scoring team's last touch, the defenders' places in the scoring frame and the build-up over 12 s before: seconds of the ball in either
    half and third as the scoring team sees it, and the trailing attack; ``build_up`` is counter_attack, sustained_pressure or other."""
    own = touches.select("match_id", "team", "t", "frame", F.col("player_id").alias("by"), F.col("touch_id").alias("id"), F.col("y").alias("at_y"), F.col("z").alias("at_z"))
    rows = matching.as_of(goals, own, ["match_id", "team"], "t", "frame", ["t", "frame", "by", "id", "at_y", "at_z"])
    rows = rows.select(*goals.columns, F.col("last_t").alias("touch_t"), F.col("last_frame").alias("touch_frame"), F.col("last_by").alias("scorer"), F.col("last_id").alias("touch_id"), F.col("last_at_z").alias("touch_z"), normalised_y(F.col("last_at_y"), F.col("team")).alias("touch_ny"))
    keys = ["match_id", "frame"]
    ball = frames.select(*keys, "ball_x", "ball_y", "ball_z")
    there = players.select(*keys, (1 - F.col("team")).alias("team"), "x", "y", "z").join(ball, keys)
    far = C.length(C.subtract(xyz(""), xyz("ball_")))
    guards = rows.select(*keys, "team", "touch_ny").join(there, [*keys, "team"]).groupBy(*keys).agg(
        F.max(normalised_y(F.col("y"), F.col("team"))).alias("last_defender_ny"), F.min(F.col("touch_ny") - normalised_y(F.col("y"), F.col("team"))).alias("margin"), F.min(far).alias("guard_distance")
    )
    rows = rows.join(guards, keys, "left")
    early = rows.select(*keys, "team", "t", (F.col("t") - BUILD_UP).alias("from"))
    seen = matching.in_window(early, frames.select("match_id", F.col("t").alias("at"), "dt", "ball_y"), MATCH, "from", "at", 0, BUILD_UP).where("at < t").withColumn("ny", normalised_y(F.col("ball_y"), F.col("team")))
    tenths = lambda c: F.sum(F.when(c, F.round(F.col("dt") * 10).cast("long")).otherwise(0))
    defended = F.max(F.when(F.col("ny") <= 0, F.col("at")))
    built = seen.groupBy(*keys).agg(tenths(F.col("ny") > 0).alias("off_half"), tenths(F.col("ny") < 0).alias("def_half"), tenths(F.col("ny") > 2300).alias("off_third"), tenths(F.col("ny") < -2300).alias("def_third"), defended.alias("defended"), F.min("at").alias("began"))
    rows = rows.join(built, keys, "left")
    attack = F.col("t") - F.coalesce("defended", "began")
    counter = (attack <= TRAIL) & ((F.col("def_half") >= 40) | (F.col("def_third") >= 10))
    sustained = (attack >= 6) & (F.col("off_half") >= 70) & (F.col("off_third") >= 35)
    return rows.withColumn("build_up", F.when(counter, "counter_attack").when(sustained, "sustained_pressure").otherwise("other")).drop("defended", "began")


def context_tags(contexts: DataFrame) -> DataFrame:
    """match_id, frame, tag of what a goal's context alone decides."""
    empty = (F.col("touch_ny") <= EMPTY_NET_Y) & (F.col("margin") >= EMPTY_NET_MARGIN) & (F.col("guard_distance") >= EMPTY_NET_DISTANCE)
    tags = F.array(
        F.when(F.col("touch_z") >= 600, "aerial"),
        F.when(F.col("touch_ny") <= 1024, "long_distance"),
        F.when((F.col("touch_ny") <= 0) & (F.col("t") - F.col("touch_t") <= 8), "own_half"),
        F.when(empty, "empty_net"),
        F.when(F.col("build_up") != "other", F.col("build_up")),
    )
    return contexts.select("match_id", "frame", F.explode(F.array_compact(tags)).alias("tag"))


def high_aerial_goals(contexts: DataFrame, touches: DataFrame) -> DataFrame:
    """Goals in whose scoring possession (the team's unbroken run of touches up to the scoring one) any touch was at 700 or above."""
    runs = temporal.islands(touches, MATCH, ["t", "frame"], F.col("team"), "possession")
    high = runs.groupBy("match_id", "possession").agg(F.max("z").alias("highest"))
    scoring = runs.select("match_id", "possession", "touch_id").join(high, ["match_id", "possession"]).where("highest >= 700")
    return contexts.join(scoring.select("match_id", "touch_id"), ["match_id", "touch_id"], "left_semi").select("match_id", "frame", F.lit("high_aerial").alias("tag"))


def mechanic_tags(contexts: DataFrame, mechanics: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """match_id, frame, tag: a goal has the tag of a mechanic (match_id, player_id, t) of its scorer within so many seconds before it, the moment itself
    included."""
    found = None
    for name, (events, within) in mechanics.items():
        done = events.select("match_id", F.col("player_id").alias("scorer"), F.col("t").alias("done"))
        scored = contexts.select("match_id", "scorer", "frame", "t")
        rows = matching.in_window(done, scored, ["match_id", "scorer"], "done", "t", 0, within).select("match_id", "frame", F.lit(name).alias("tag")).distinct()
        found = rows if found is None else found.unionByName(rows)
    return found


def scoring_touch_tags(contexts: DataFrame, players: DataFrame, passes: DataFrame, within: float = 3.0) -> DataFrame:
    """match_id, frame, tag of what the scorer's last touch was, up to ``within`` before the goal: a flip into the ball, or the receiving of a pass."""
    recent = contexts.where(F.col("t") - F.col("touch_t") <= within).select("match_id", "frame", "touch_frame", "scorer")
    flips = recent.join(players.where("dodging").select("match_id", F.col("frame").alias("touch_frame"), F.col("player_id").alias("scorer")), ["match_id", "touch_frame", "scorer"], "left_semi")
    received = recent.join(passes.select("match_id", F.col("frame").alias("touch_frame"), F.col("receiver").alias("scorer")), ["match_id", "touch_frame", "scorer"], "left_semi")
    return flips.select("match_id", "frame", F.lit("flip_into_ball").alias("tag")).unionByName(received.select("match_id", "frame", F.lit("passing").alias("tag")))


def demolition_goals(contexts: DataFrame, demolitions: DataFrame, starts: DataFrame, within: float = 5.25) -> DataFrame:
    """Goals with a demolition (match_id, team, t) by the scoring team up to ``within`` before, in the same play: not before the last kickoff."""
    rows = matching.as_of(contexts, starts.select("match_id", "t", "frame"), MATCH, "t", "frame", ["t"])
    done = demolitions.select("match_id", "team", F.col("t").alias("done"))
    pairs = matching.in_window(done, rows.select("match_id", "team", "frame", "t", "last_t"), ["match_id", "team"], "done", "t", 0, within)
    same_play = F.coalesce(F.col("done") >= F.col("last_t") - PLAY_SLACK, F.lit(True))
    return pairs.where(same_play).select("match_id", "frame", F.lit("demo").alias("tag")).distinct()


def kickoff_goals(contexts: DataFrame, starts: DataFrame, touches: DataFrame, frames: DataFrame) -> DataFrame:
    """Goals that flow from a kickoff: less than 12 s after its first touch, while the conceding team never settled the ball (two of its touches running, more than 0.35 s apart) and the ball
    never went back far into the scoring team's own half."""
    begun = starts.select("match_id", F.col("frame").alias("start_frame"), "frame", "t")
    first = matching.as_of(touches.select("match_id", "frame", "t"), begun, MATCH, "t", "frame", ["start_frame"]).where("last_start_frame IS NOT NULL")
    first = first.groupBy("match_id", F.col("last_start_frame").alias("start_frame")).agg(F.min("t").alias("first_t"))
    rows = matching.as_of(contexts.select("match_id", "frame", "t", "team"), begun, MATCH, "t", "frame", ["start_frame"]).withColumnRenamed("last_start_frame", "start_frame")
    rows = rows.join(first, ["match_id", "start_frame"]).where((F.col("t") >= F.col("first_t")) & (F.col("t") - F.col("first_t") < KICKOFF_GOAL))
    goal = ["match_id", "frame", "team"]
    hits = matching.in_window(rows, touches.select("match_id", F.col("t").alias("at"), F.col("frame").alias("at_frame"), F.col("team").alias("by")), MATCH, "first_t", "at", 0, KICKOFF_GOAL).where("at <= t")
    runs = temporal.islands(hits, goal, ["at", "at_frame"], F.col("by"), "run").where("by <> team").groupBy(*goal, "run").agg((F.max("at") - F.min("at")).alias("held"))
    settled = runs.where(F.round("held", 6) > KICKOFF_CONTEST).select(*goal).distinct()
    seen = matching.in_window(rows, frames.select("match_id", F.col("t").alias("at"), "ball_y"), MATCH, "first_t", "at", 0, KICKOFF_GOAL).where("at <= t")
    reset = seen.where(normalised_y(F.col("ball_y"), F.col("team")) < -KICKOFF_RESET).select(*goal).distinct()
    return rows.join(settled, goal, "left_anti").join(reset, goal, "left_anti").select("match_id", "frame", F.lit("kickoff").alias("tag"))


# --- spans


def merged_spans(spans: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """spans(keys, start, end) with those joined that follow each other within ``gap``: keys, start, end, n_parts."""
    w = temporal.ordered(keys, ["start", "end"])
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = temporal.segment(spans.withColumn("__new", reach.isNull() | (F.col("start") - reach > gap)), keys, ["start", "end"], F.col("__new"), "__part")
    return numbered.groupBy(*keys, "__part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_parts")).drop("__part")


def covered_by(points: DataFrame, sessions: DataFrame, keys: list[str], longest: float, columns: list[str]) -> DataFrame:
    """points (keys, t) with the columns of the latest session (keys, start, end) that covers them, null if none does. ``longest`` bounds a session."""
    w = Window.partitionBy(*keys, "__id").orderBy(F.desc("start"))
    marked = points.withColumn("__id", F.struct(*points.columns))
    inside = matching.in_window(sessions, marked, keys, "start", "t", 0, longest).where("t <= end")
    best = inside.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, "__id", *(F.col(c).alias(f"session_{c}") for c in columns))
    return marked.join(best, [*keys, "__id"], "left").drop("__id")


def trailing_run(samples: DataFrame, keys: list[str], order: list[str], condition: Column) -> DataFrame:
    """keys, n, since: how many samples at the end of each key's series fulfil the condition without a break, and the first clock of them."""
    last_break = F.max(F.when(~F.coalesce(F.col("__is"), F.lit(False)), F.struct(*order))).over(Window.partitionBy(*keys))
    rows = samples.withColumn("__is", condition).withColumn("__break", last_break)
    after = F.col("__break").isNull() | (F.struct(*order) > F.col("__break"))
    return rows.groupBy(*keys).agg(F.sum(after.cast("long")).alias("n"), F.min(F.when(after, F.col(order[0]))).alias("since"))


def travel_by_state(samples: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Path lengths per key, split by the state at the end of each step."""
    w = temporal.ordered(keys, order)
    step = C.length(tuple(F.col(c) - F.lag(c).over(w) for c in "xyz"))
    return samples.withColumn("__step", F.coalesce(step, F.lit(0.0))).groupBy(*keys, state).agg(F.sum("__step").alias("distance"), F.count("*").alias("n_samples"))


def overlaid(committed: DataFrame, pending: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Committed partial sums with those of pending events laid over them: as if all had been summed at once."""
    return committed.select(*keys, *sums).unionByName(pending.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def caught_up(snapshot: DataFrame, history: DataFrame, keys: list[str], clock: str, value: str, at) -> DataFrame:
    """What a late joiner knows: the snapshot taken at ``at`` with the history after it laid over: keys, value, clock of the latest row of each key."""
    later = history.where(F.col(clock) > at).select(*keys, clock, value)
    both = snapshot.select(*keys, clock, value).unionByName(later)
    return both.groupBy(*keys).agg(F.max_by(value, clock).alias(value), F.max(clock).alias(clock))
