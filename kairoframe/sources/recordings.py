"""Match recordings as tables: frames, players, touches, goals and the raw changes they come from.

Any reader that yields these columns feeds the detectors. Here they are derived from the events table, so that every detector can be run on
generated data of any size: four users play a match, an event is a frame, and positions are triangle waves of the frame's number, with a dash at each other
every forty frames. The derivation is plain expressions (``FRAME``, ``PLAYER``), which SQL reads as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoframe.operators import temporal
from kairoframe.sources.shared import SharedTables
from kairoframe.sources.tables import micros, table

MATCH, PLAYER_KEYS = ["match_id"], ["match_id", "player_id"]


def wave(u: str, height: int) -> str:
    """A triangle wave of u between 0 and height."""
    return f"CAST(abs(({u}) % {2 * height} - {height}) AS DOUBLE)"


FRAME = {
    "t": "CAST(frame AS DOUBLE) / 10",
    "dt": "CAST(CASE WHEN frame = 1 THEN 0 ELSE 1 END AS DOUBLE) / 10",
    "live": "NOT (event_type = 'error' AND k % 3 = 0)",
    "ball_x": "(" + wave("frame * 97 + match_id * 1013", 7000) + " - 3500) * CASE WHEN match_id % 3 = 1 THEN 0.25 ELSE 1 END",
    # Slow in some matches, so that it stays in a half for long; some hits send it on towards the goal that the player attacks.
    "ball_y": wave("frame * (CASE WHEN match_id % 5 = 0 THEN 31 ELSE 211 END) + match_id * 3001", 10200) + " - 5100 + CASE WHEN event_type IN ('click', 'view') AND (k % 3 = 0 OR match_id % 3 = 1) THEN CAST(300 * (1 - 2 * (user_id % 2)) AS DOUBLE) ELSE 0 END",
    "ball_z": wave("frame * 29 + match_id * 577", 900) + " + 93",
    "kickoff": "event_type = 'signup' AND k % 3 = 0",
    "goal": "event_type = 'purchase' AND k % 7 = 0",
    "hit": "CASE WHEN k % 50 <> 49 THEN NOT (event_type = 'error' AND k % 2 = 0) END",
}
PLAYER = {
    "team": "CAST(player_id % 2 AS INT)",
    "x": "ball_x - 800 + " + wave("frame * (7 + 2 * (player_id % 5)) + player_id * 211", 1600),
    "y": "ball_y - 1200 + " + wave("frame * (11 + 2 * (player_id % 3)) + player_id * 307", 2400) + " + CASE WHEN frame % 40 < 4 THEN CAST(150 * (frame % 40) * (1 - 2 * (player_id % 2)) AS DOUBLE) ELSE 0 END",
    "z": "17 + greatest(0, " + wave("frame * 53 + player_id * 419", 1600) + " - 800)",
    "powerslide": "(frame + 3 * player_id) % 17 < 5",
    "dodging": "(frame + 7 * player_id) % 29 < 3",
    "boost": wave("frame * 3 + player_id * 29", 255),
    "up_z": "CAST((frame * 13 + player_id * 17) % 200 - 100 AS DOUBLE) / 100",
}


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """match_id, frame, event_id, user_id (who did what the frame is known for), event_type, cents, k, FRAME's columns, the ball's velocity."""
    rows = table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.expr("user_id div 4").alias("match_id"),
        micros("ts").alias("us"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    numbered = rows.withColumn("frame", F.row_number().over(Window.partitionBy("match_id").orderBy("us", "event_id")).cast("long")).drop("us")
    w = temporal.ordered(MATCH, ["frame"])
    placed = numbered.select("*", *(F.expr(e).alias(c) for c, e in FRAME.items()))
    return placed.select("*", *(F.coalesce((F.col(f"ball_{c}") - F.lag(f"ball_{c}").over(w)) * 10, F.lit(0.0)).alias(f"ball_v{c}") for c in "xyz"))


def players(frames: DataFrame) -> DataFrame:
    """One row per frame and player of the match: match_id, frame, t, dt, live, player_id, PLAYER's columns, the velocity."""
    roster = frames.select("match_id", F.col("user_id").alias("player_id")).distinct()
    rows = frames.select("match_id", "frame", "t", "dt", "live", "ball_x", "ball_y").join(roster, "match_id")
    placed = rows.select("match_id", "frame", "t", "dt", "live", "player_id", *(F.expr(e).alias(c) for c, e in PLAYER.items()))
    w = temporal.ordered(PLAYER_KEYS, ["frame"])
    return placed.select("*", *(F.coalesce((F.col(c) - F.lag(c).over(w)) * 10, F.lit(0.0)).alias(f"v{c}") for c in "xyz"))


def touches(frames: DataFrame) -> DataFrame:
    rows = frames.where("event_type IN ('click', 'view')")
    return rows.select("match_id", "frame", "t", F.col("event_id").alias("touch_id"), F.col("user_id").alias("player_id"), F.expr("CAST(user_id % 2 AS INT)").alias("team"), *(F.col(f"ball_{c}").alias(c) for c in "xyz"), "k")


def goals(frames: DataFrame) -> DataFrame:
    """Goals with the score after each; every third has no known score."""
    rows = frames.where("goal").select("match_id", "frame", "t", F.col("user_id").alias("player_id"), F.expr("CAST(user_id % 2 AS INT)").alias("team"), "k")
    w = temporal.running(MATCH, ["frame"])
    return rows.select("*", *(F.when(F.col("k") % 3 > 0, F.sum((F.col("team") == i).cast("int")).over(w)).alias(f"score{i}") for i in (0, 1)))


class Recording:
    """All matches, read in one pass: frames and players are derived and written once, by match, and every consumer reads them from there. Event streams that several consumers
    need (``stream``) are made by the first of them and kept alike."""

    def __init__(self, frames: DataFrame, buckets: int | None = None) -> None:
        self.tables = SharedTables(frames.sparkSession, "match_id", ["frame", "player_id"], buckets)
        self.frames = self.tables.keep("frames", frames)
        self.players = self.tables.keep("players", players(self.frames))
        self.touches, self.goals = touches(self.frames), goals(self.frames)
        self.streams: dict[str, DataFrame] = {}

    @staticmethod
    def of(spark: SparkSession, folder: str, buckets: int | None = None) -> Recording:
        return Recording(frames(spark, folder), buckets)

    def stream(self, name: str, make: Callable[[Recording], DataFrame]) -> DataFrame:
        if name not in self.streams:
            self.streams[name] = self.tables.keep(name, make(self))
        return self.streams[name]

    def consumed(self, detectors: dict[str, Callable[[Recording], DataFrame]]) -> dict[str, DataFrame]:
        """What each detector finds, all from this one pass."""
        return {name: self.stream(name, make) for name, make in detectors.items()}

    def close(self) -> None:
        self.streams = {}
        self.tables.close()


#: Running play, with rarer touches, some by two at once: what possession is read from. Stoppages last until play is taken up again.
PLAY = {
    "ms": "frame * 100",
    "dt_ms": "CAST(CASE WHEN frame = 1 THEN 0 ELSE 100 END AS BIGINT)",
    "mark": "CASE WHEN event_type = 'error' AND k % 25 = 0 THEN 0 WHEN event_type = 'signup' AND k % 4 = 0 THEN 1 END",
    "third": "CASE WHEN ball_y < -2300 THEN 'team0_third' WHEN ball_y < 2300 THEN 'middle' ELSE 'team1_third' END",
    "hit": "event_type IN ('click', 'view') AND k % 4 = 0",
    "other": "match_id * 4 + (user_id + 1) % 4",
}
TOUCHERS = {f"toucher{i}": f"CASE WHEN hit AND user_id % 2 = {i} THEN user_id WHEN hit AND k % 20 = 0 THEN other END" for i in (0, 1)}
_BELOW = "(frame + 5 * player_id) % 41 < 9"
STRAYED = {
    "x": f"CASE WHEN {_BELOW} THEN bx - 40 ELSE x END",
    "y": f"CASE WHEN {_BELOW} THEN b2 + 30 WHEN (frame + 17 * player_id) % 67 < 14 THEN y + 2600 ELSE y END",
    "z": f"CASE WHEN {_BELOW} THEN greatest(CAST(17 AS DOUBLE), bz - 120) ELSE z END",
}


def play(frames: DataFrame) -> DataFrame:
    """Every frame with ms, dt_ms, third, toucher0, toucher1, prev_ball_y, in_play, stretch (a number of each stretch of play and of each stoppage), and in the last frame of a
    stretch end_ms and end_frame, of the frame after it (-1: none)."""
    w = temporal.ordered(MATCH, ["frame"])
    rows = frames.select("match_id", "frame", "event_id", "user_id", "event_type", "k", "ball_x", "ball_y", "ball_z", *(F.expr(e).alias(c) for c, e in PLAY.items()))
    rows = rows.select("*", *(F.expr(e).alias(c) for c, e in TOUCHERS.items()), F.lag("ball_y").over(w).alias("prev_ball_y"), (F.coalesce(F.last("mark", ignorenulls=True).over(temporal.running(MATCH, ["frame"])), F.lit(1)) == 1).alias("in_play"))
    rows = temporal.islands(rows, MATCH, ["frame"], F.col("in_play"), "stretch").drop("state", "mark", "other", "hit")
    after = F.lead("stretch").over(w)
    ends = after.isNull() | (after != F.col("stretch"))
    return rows.withColumns({f"end_{c}": F.when(ends, F.coalesce(F.lead(c).over(w), F.lit(-1))) for c in ("ms", "frame")})


def strayed(players: DataFrame, frames: DataFrame) -> DataFrame:
    """players, each of whom is now and then far from the ball, and now and then right below it."""
    ball = frames.select("match_id", "frame", *(F.col(f"ball_{c}").alias(n) for c, n in zip("xyz", ("bx", "b2", "bz"))))
    return players.join(ball, ["match_id", "frame"]).withColumns({c: F.expr(e) for c, e in STRAYED.items()}).drop("bx", "b2", "bz")


#: Dodges granted anew, and what they need of the cars.
RESET = {
    "dodging": "(frame + 7 * player_id) % 23 < 2",
    "touched": "user_id = player_id AND event_type IN ('click', 'view')",
    "touch_contact": "k % 3 = 0",
    "refreshed": "user_id = player_id AND event_type IN ('signup', 'purchase', 'view') AND k % 5 > 0",
    "up": "CAST((frame * 13 + player_id * 17) % 40 - 20 AS DOUBLE) / 100",
}


def dodge_frames(frames: DataFrame, players: DataFrame) -> DataFrame:
    """Every frame of every player with what resets.py needs but on_ball, for which it has x, y, z, the ball's place (bx, b2, bz) and ``up``."""
    flags = play(frames).join(frames.select("match_id", "frame", "goal"), ["match_id", "frame"]).select("match_id", "frame", "ms", "user_id", "event_type", "k", "goal", "in_play", *(F.col(f"ball_{c}").alias(n) for c, n in zip("xyz", ("bx", "b2", "bz"))))
    body = strayed(players, frames).select("match_id", "frame", "player_id", "team", "x", "y", "z").join(flags, ["match_id", "frame"])
    return body.select("*", *(F.expr(e).alias(c) for c, e in RESET.items()))


#: Reports of boost pads and jumps of players' boosts: a jump is seen up to two frames off its report, or four (too far), or without one; its kind may be unknown or another.
REPORTS = {"kind": "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END", "reported": "event_type = 'purchase' AND k % 9 > 0"}
JUMPS = {
    "off": "CASE WHEN k % 13 = 0 THEN 4 ELSE k % 5 - 2 END",
    "seen": "(event_type = 'purchase' AND k % 3 > 0) OR (event_type = 'signup' AND k % 6 = 0)",
    "jump_kind": "CASE WHEN k % 7 = 0 THEN -1 WHEN k % 11 = 0 THEN 1 ELSE CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END END",
    "before": "CAST((frame * 37 + user_id * 11) % 256 AS DOUBLE)",
}


def pad_reports(frames: DataFrame) -> DataFrame:
    rows = frames.select("match_id", F.col("user_id").alias("player_id"), "frame", *(F.expr(e).cast("int" if c == "kind" else "boolean").alias(c) for c, e in REPORTS.items()))
    return rows.where("reported").drop("reported")


def boost_jumps(frames: DataFrame) -> DataFrame:
    rows = frames.select("match_id", F.col("user_id").alias("player_id"), "frame", F.expr("CAST(user_id % 2 AS INT)").alias("team"), F.col("ball_y").alias("y"), *(F.expr(e).alias(c) for c, e in JUMPS.items()))
    return rows.where("seen").select("match_id", "player_id", (F.col("frame") + F.col("off")).alias("frame"), F.col("jump_kind").cast("int").alias("kind"), "before", F.least(F.lit(255.0), F.col("before") + 31).alias("after"), "y", "team")


#: Cars that turn around after a dodge, some of them all the way, some back again: m: frames since the dodge, c: the number of the dodge.
FLIP = {
    "m": "(frame + 7 * player_id) % 23",
    "c": "(frame + 7 * player_id) // 23",
    "yaw": "least(m, 6) * (CASE c % 6 WHEN 0 THEN 0.2 WHEN 1 THEN 0.45 WHEN 2 THEN 0.5 WHEN 3 THEN 0.55 WHEN 4 THEN 0.52 ELSE 0.48 END) + CASE WHEN c % 5 = 4 AND m BETWEEN 6 AND 6 THEN 1.2 ELSE 0 END + c * 0.7",
    "pitch": "CASE WHEN m BETWEEN 1 AND 4 THEN 0.35 + 0.11 * ((c + player_id) % 6) WHEN m > 20 AND c % 4 = 2 THEN 0.8 ELSE 0 END",
    "spin": "CASE WHEN c % 3 = 1 THEN 300 ELSE 100 END",
    "dodging": "m < 2",
}


def flip_frames(frames: DataFrame, players: DataFrame) -> DataFrame:
    """Every frame of every player with what half_flips.py needs but the nose's vector, for which it has yaw and pitch."""
    rows = players.select("match_id", "player_id", "team", "frame", "vx", "vy").join(play(frames).select("match_id", "frame", "ms", "in_play"), ["match_id", "frame"])
    for name, e in FLIP.items():
        rows = rows.withColumn(name, F.expr(e.replace("//", "div")).cast("boolean" if name == "dodging" else "long" if name in "mc" else "double"))
    return rows


#: The same tables as common table expressions.
SQL_FRAMES = f"""ev AS (
  SELECT event_id, user_id, user_id // 4 AS match_id, row_number() OVER (PARTITION BY user_id // 4 ORDER BY epoch_us(ts), event_id) AS frame, event_type,
    CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
fr0 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in FRAME.items())} FROM ev),
fr AS (SELECT *, {', '.join(f'coalesce((ball_{c} - lag(ball_{c}) OVER fw) * 10, 0) AS ball_v{c}' for c in 'xyz')} FROM fr0 WINDOW fw AS (PARTITION BY match_id ORDER BY frame))"""
SQL_PLAYERS = f"""{SQL_FRAMES},
ro AS (SELECT DISTINCT match_id, user_id AS player_id FROM ev),
pl0 AS (SELECT match_id, frame, t, dt, live, player_id, ball_x, ball_y, ball_z, {', '.join(f'{e} AS {c}' for c, e in PLAYER.items())} FROM fr JOIN ro USING (match_id)),
pl AS (SELECT *, {', '.join(f'coalesce(({c} - lag({c}) OVER pw) * 10, 0) AS v{c}' for c in 'xyz')} FROM pl0 WINDOW pw AS (PARTITION BY match_id, player_id ORDER BY frame))"""
SQL_TOUCHES = "tc AS (SELECT match_id, frame, t, event_id AS touch_id, user_id AS player_id, CAST(user_id % 2 AS INT) AS team, ball_x AS x, ball_y AS y, ball_z AS z, k FROM fr WHERE event_type IN ('click', 'view'))"
SQL_GOALS = """go0 AS (SELECT match_id, frame, t, user_id AS player_id, CAST(user_id % 2 AS INT) AS team, k FROM fr WHERE goal),
go AS (SELECT *, CASE WHEN k % 3 > 0 THEN sum((team = 0)::INT) OVER gw END AS score0, CASE WHEN k % 3 > 0 THEN sum((team = 1)::INT) OVER gw END AS score1 FROM go0 WINDOW gw AS (PARTITION BY match_id ORDER BY frame))"""
SQL_PLAY = f"""py0 AS (SELECT match_id, frame, event_id, user_id, event_type, k, ball_x, ball_y, ball_z, {', '.join(f'{e} AS {c}' for c, e in PLAY.items())} FROM fr),
py1 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in TOUCHERS.items())}, lag(ball_y) OVER pyw AS prev_ball_y, coalesce(last_value(mark IGNORE NULLS) OVER pyw, 1) = 1 AS in_play FROM py0 WINDOW pyw AS (PARTITION BY match_id ORDER BY frame)),
py2 AS (SELECT *, lag(in_play) OVER (PARTITION BY match_id ORDER BY frame) AS was FROM py1),
py3 AS (SELECT *, CAST(sum(CASE WHEN was IS NULL OR in_play <> was THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame) AS BIGINT) AS stretch FROM py2),
py4 AS (SELECT *, lead(stretch) OVER pyw AS after, lead(ms) OVER pyw AS next_ms, lead(frame) OVER pyw AS next_frame, row_number() OVER (PARTITION BY match_id, stretch ORDER BY frame) AS rn FROM py3 WINDOW pyw AS (PARTITION BY match_id ORDER BY frame)),
py AS (SELECT *, CASE WHEN after IS DISTINCT FROM stretch THEN coalesce(next_ms, -1) END AS end_ms, CASE WHEN after IS DISTINCT FROM stretch THEN coalesce(next_frame, -1) END AS end_frame FROM py4)"""
SQL_RESET = f"""dz0 AS (SELECT pl.match_id, pl.frame, pl.player_id, team, {', '.join(f'{e} AS {c}' for c, e in STRAYED.items())}, bx, b2, bz FROM (SELECT match_id, frame, player_id, team, x, y, z, ball_x AS bx, ball_y AS b2, ball_z AS bz FROM pl) pl),
dz AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in RESET.items())} FROM dz0 JOIN (SELECT py.match_id, py.frame, py.ms, py.user_id, py.event_type, py.k, fr.goal, py.in_play FROM py JOIN fr ON fr.match_id = py.match_id AND fr.frame = py.frame) USING (match_id, frame))"""
SQL_PICKUPS = f"""rp AS (SELECT match_id, user_id AS player_id, frame, {REPORTS['kind']} AS kind FROM fr WHERE {REPORTS['reported']}),
jp AS (SELECT match_id, user_id AS player_id, frame + {JUMPS['off']} AS frame, {JUMPS['jump_kind']} AS kind, {JUMPS['before']} AS before, ball_y AS y, CAST(user_id % 2 AS INT) AS team FROM fr WHERE {JUMPS['seen']}),
pu AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY frame, source, kind, before, y) AS id FROM (SELECT match_id, player_id, frame, kind, 0 AS source, CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS INT) AS team FROM rp UNION ALL SELECT match_id, player_id, frame, kind, 1, before, y, team FROM jp))"""
SQL_FLIP = f"""hf0 AS (SELECT *, {FLIP['m']} AS m, {FLIP['c']} AS c FROM (SELECT match_id, player_id, team, frame, vx, vy, ms, in_play FROM (SELECT match_id, player_id, team, frame, vx, vy FROM pl) JOIN (SELECT match_id, frame, ms, in_play FROM py) USING (match_id, frame))),
hf AS (SELECT *, CAST({FLIP['yaw']} AS DOUBLE) AS yaw, CAST({FLIP['pitch']} AS DOUBLE) AS pitch, {FLIP['spin']} AS spin, {FLIP['dodging']} AS dodging FROM hf0)"""
