"""Who has the ball: team possession, strict and loose, and players' possessions.

Rows are frames in order: match_id, stretch (a number of running play), frame, ms, toucher0 and toucher1 (the player of each team who touched the ball in the frame, or null), end_ms and
end_frame (only in the last frame of a stretch: of the frame after it; -1 and -1 if there is none).

Three mechanisms:

* Decisions in hindsight are scans over columns (scans.py): Python runs once a touch or lapse, and finds lapses by array searches. A segment is final once it is emitted; its end
  lies before the frame that decided it.
* Totals with savepoints need no state: what a hold adds up after its last touch is taken back, so a frame counts if the hold has a touch at or after it, which is one window.
* A hold that is interrupted for a short time goes on: runs of the same holder are joined over the run without one between them, which is a lag over runs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import scans, temporal
from kairoframe.operators.detectors import CARRY_GAP, CARRY_HIGH, CARRY_LOW, CARRY_RISE, GROUND_Z
from kairoframe.operators.derive import on_surface
from kairoframe.operators.scans import Scan

# Milliseconds and uu.
TURNOVER, LOOSE, STRICT_WINDOW, LOOSE_WINDOW = 1250, 3000, 3000, 1500
RESUME, TOUCH_APART, LEAST_TOUCHES, REACH = 2000, 120, 2, 2500.0
CLOSE, CLOSE_TIME, EPISODE_TIME, TOUCH_SPAN = 700.0, 750, 1000, 1000

KEYS = ["match_id", "stretch"]
INPUT = ["ms", "toucher0", "toucher1", "end_ms", "end_frame"]
LABELS = {0: "team_zero", 1: "team_one", -1: "neutral"}


class Touch(NamedTuple):
    """What a frame's touches say: ``team`` touched alone, or both did (None); the players by team, None where unknown."""

    team: int | None
    players: tuple[int | None, int | None]


class Hold(NamedTuple):
    """A resolver's state. ``phase``: neutral, acquiring, held or challenged. ``last`` and ``rival`` are (ms, frame) of the holder's last touch and of the challenger's first."""

    phase: str = "neutral"
    team: int = -1
    player: int | None = None
    last: tuple[int, int] = (0, 0)
    rival: tuple[int, int] = (0, 0)
    rival_player: int | None = None


End = tuple[tuple[int, int], int, "int | None"]  # where a segment ends, its team (-1: neutral) and player
Step = Callable[[Hold, Touch, tuple[int, int]], tuple[Hold, list[End]]]
Lapse = Callable[[Hold], tuple[int | None, Hold, list[End]]]  # after which time a hold lapses (None: never), and what is then


def strict_touch(s: Hold, touch: Touch, now: tuple[int, int]) -> tuple[Hold, list[End]]:
    """Two touches running by one team are a hold, from the first of them on; another team takes over with two touches running, and between them and the last touch of
    the one before nobody has the ball. One touch grants nothing."""
    alone = touch.team is not None
    if s.phase == "neutral":
        return (Hold("acquiring", touch.team, touch.players[touch.team], now) if alone else s), []
    if s.phase == "acquiring":
        if not alone:
            return s, []
        if touch.team != s.team:
            return Hold("acquiring", touch.team, touch.players[touch.team], now), []
        return Hold("held", s.team, _or(touch.players[s.team], s.player), now), [(s.last, -1, None)]
    other = 1 - s.team
    if alone and touch.team == s.team:
        return Hold("held", s.team, _or(touch.players[s.team], s.player), now), []
    if s.phase == "held":
        return challenged(s, touch, now), []
    return Hold("held", other, _or(touch.players[other], s.rival_player), now), [(s.last, s.team, s.player), (s.rival, -1, None)]


def strict_lapse(s: Hold) -> tuple[int | None, Hold, list[End]]:
    """Without another touch a hold ends at its last one."""
    if s.phase == "neutral":
        return None, s, []
    since = s.rival if s.phase == "challenged" else s.last
    return since[0] + STRICT_WINDOW, Hold(), [] if s.phase == "acquiring" else [(s.last, s.team, s.player)]


def loose_touch(s: Hold, touch: Touch, now: tuple[int, int]) -> tuple[Hold, list[End]]:
    """The team that touched last has the ball until another demonstrably takes it, by two touches running or by one that is not answered; from its first touch on."""
    alone = touch.team is not None
    if s.phase == "neutral":
        return (Hold("held", touch.team, touch.players[touch.team], now), [(now, -1, None)]) if alone else (s, [])
    if alone and touch.team == s.team:
        return Hold("held", s.team, _or(touch.players[s.team], s.player), now), []
    if s.phase == "held":
        return challenged(s, touch, now), []
    if not alone:
        return s, []
    return Hold("held", touch.team, _or(touch.players[touch.team], s.rival_player), now), [(s.rival, s.team, s.player)]


def loose_lapse(s: Hold) -> tuple[int | None, Hold, list[End]]:
    if s.phase != "challenged":
        return None, s, []
    return s.rival[0] + LOOSE_WINDOW, Hold("held", 1 - s.team, s.rival_player, s.rival), [(s.rival, s.team, s.player)]


def challenged(s: Hold, touch: Touch, now: tuple[int, int]) -> Hold:
    """The holder after a touch of the other team, or of both."""
    both = touch.team is None
    return Hold("challenged", s.team, _or(touch.players[s.team], s.player) if both else s.player, now if both else s.last, now, touch.players[1 - s.team])


def _or(a: int | None, b: int | None) -> int | None:
    return b if a is None else a


def strict_flush(s: Hold, end: tuple[int, int]) -> list[End]:
    return [*([(s.last, s.team, s.player)] if s.phase in ("held", "challenged") else []), (end, -1, None)]


def loose_flush(s: Hold, end: tuple[int, int]) -> list[End]:
    return [(end, s.team, s.player)]


def resolver(touched: Step, lapse: Lapse, flush: Callable[[Hold, tuple[int, int]], list[End]]) -> Scan:
    """A scan that emits segments: start_ms, start_frame, end_ms, end_frame, team, player; each with the frame that decided it. State: (where the open segment began, Hold)."""

    def scan(state, columns):
        frame, ms, zero, one, end_ms, end_frame = columns
        opened, s = state or ((int(ms[0]), int(frame[0])), Hold())
        out: list[tuple] = []

        def close(row: int, ends: list[End]) -> None:
            nonlocal opened
            for at, team, player in ends:
                if at[0] > opened[0]:
                    out.append((row, *opened, *at, team, player))
                opened = at

        def lapses(after_row: int, until: int) -> None:
            """Whatever lapses in a frame between these rows, none of which has a touch."""
            nonlocal s
            while (after := lapse(s))[0] is not None:
                row = max(after_row + 1, int(np.searchsorted(ms, after[0], side="right")))
                if row >= until:
                    return
                s = after[1]
                close(row, after[2])

        before = -1
        for i in np.flatnonzero((zero >= 0) | (one >= 0)).tolist():
            lapses(before, i)
            before = i
            by = (int(zero[i]) if zero[i] >= 0 else None, int(one[i]) if one[i] >= 0 else None)
            s, ends = touched(s, Touch(None if None not in by else 0 if by[1] is None else 1, by), (int(ms[i]), int(frame[i])))
            close(i, ends)
        lapses(before, len(ms))
        last = len(ms) - 1
        if end_ms[last] >= 0:
            close(last, flush(s, (int(end_ms[last]), int(end_frame[last]))))
        elif end_frame[last] == -1:  # the recording ends here: what is open stays as it stands
            close(last, [((int(ms[last]), int(frame[last])), s.team if s.phase in ("held", "challenged") else -1, s.player if s.phase in ("held", "challenged") else None)])
        rows, *values = np.array([tuple(-1 if x is None else x for x in r) for r in out], np.int64).reshape(-1, 7).T
        return (opened, s), rows, values

    return scan


def _input(rows: DataFrame) -> DataFrame:
    """Rows for a scan: no player is -1; within a stretch end_ms is -1 and end_frame -2."""
    return rows.withColumns({"toucher0": F.coalesce("toucher0", F.lit(-1)), "toucher1": F.coalesce("toucher1", F.lit(-1)), "end_ms": F.coalesce("end_ms", F.lit(-1)), "end_frame": F.coalesce("end_frame", F.lit(-2))})


def _known(name: str) -> Column:
    return F.when(F.col(name) >= 0, F.col(name)).alias(name)


def segments(rows: DataFrame, scan: Scan) -> DataFrame:
    """match_id, stretch, start_ms, start_frame, end_ms, end_frame, state, player_id, decided_frame of every stretch of play."""
    schema = "match_id long, stretch long, frame long, start_ms long, start_frame long, end_ms long, end_frame long, team long, player_id long"
    found = scans.scanned(_input(rows), KEYS, ["frame"], INPUT, scan, schema)
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("team").cast("int"))
    return found.select(*KEYS, "start_ms", "start_frame", "end_ms", "end_frame", label.alias("state"), _known("player_id"), F.col("frame").alias("decided_frame"))


def strict_possessions(rows: DataFrame) -> DataFrame:
    return segments(rows, resolver(strict_touch, strict_lapse, strict_flush))


def loose_possessions(rows: DataFrame) -> DataFrame:
    return segments(rows, resolver(loose_touch, loose_lapse, loose_flush))


def with_stoppages(found: DataFrame, stopped: DataFrame) -> DataFrame:
    """Segments with one inactive one for each stretch that is not played. stopped: match_id, stretch, frame, ms."""
    idle = stopped.groupBy(*KEYS).agg(F.min("ms").alias("start_ms"), F.min("frame").alias("start_frame"), F.max("ms").alias("end_ms"), F.max("frame").alias("end_frame"))
    return found.withColumn("active", F.lit(True)).unionByName(idle.withColumns({"active": F.lit(False), "state": F.lit("neutral")}), allowMissingColumns=True)


# --- the holder at every frame


class Control(NamedTuple):
    """Who holds the ball now: ``team`` and ``player`` (nobody while another team's touch waits for a second one, since ``pending``)."""

    team: int | None = None
    player: int | None = None
    last: int | None = None
    pending: int | None = None


def control() -> Scan:
    """A scan that gives every frame its holder: the team that touched keeps the ball until the other touches twice within 1.25 s; a single touch of the other that stays alone, or 3 s
    without a touch, leave it to nobody. Both at once count as a touch of the other."""

    def after(s: Control, touch: Touch, now: int) -> Control:
        if touch.team is None:
            return s._replace(pending=None, player=None) if s.team is None else Control(s.team, None, now, now)
        if s.team is not None and touch.team != s.team and s.pending is None:
            return Control(s.team, None, s.last, now)
        mine = touch.players[touch.team]
        return Control(touch.team, mine if mine is not None or touch.team != s.team else s.player, now)

    def scan(s, columns):
        _, ms, zero, one = columns[:4]
        s = s or Control()
        team, player = np.full(len(ms), -1), np.full(len(ms), -1)
        done = 0

        def fill(until: int) -> None:
            nonlocal done
            if s.team is not None:
                team[done:until] = s.team
                player[done:until] = -1 if s.player is None else s.player
            done = until

        def lapses(until: int, inclusive: bool) -> None:
            """A hold that lapses before row ``until``, or in it, ends there."""
            nonlocal s
            since = s.last + LOOSE if s.pending is None and s.last is not None else s.pending + TURNOVER if s.pending is not None else None
            if since is not None and (row := int(np.searchsorted(ms, since))) < until + inclusive:
                fill(row)
                s = Control()

        for i in np.flatnonzero((zero >= 0) | (one >= 0)).tolist():
            lapses(i, True)
            fill(i)
            by = (int(zero[i]) if zero[i] >= 0 else None, int(one[i]) if one[i] >= 0 else None)
            s = after(s, Touch(None if None not in by else 0 if by[1] is None else 1, by), int(ms[i]))
        lapses(len(ms), False)
        fill(len(ms))
        return s, np.arange(len(ms)), [team, player]

    return scan


def holders(rows: DataFrame) -> DataFrame:
    """match_id, stretch, frame, holder_team, holder of every frame of play."""
    found = scans.scanned(_input(rows), KEYS, ["frame"], INPUT, control(), "match_id long, stretch long, frame long, holder_team long, holder long")
    return found.select(*KEYS, "frame", _known("holder_team"), _known("holder"))


# --- players' possessions


def within_reach(rows: DataFrame, players: DataFrame) -> DataFrame:
    """rows (with holder, ball_x, ball_y, ball_z) with the holder's place, px, py, pz, ``ball_gap`` and ``current``: the holder if not known to be out of reach."""
    place = players.select("match_id", "frame", F.col("player_id").alias("holder"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    joined = rows.join(place, ["match_id", "frame", "holder"], "left")
    gap = C.length(tuple(F.col(f"p{c}") - F.col(f"ball_{c}") for c in "xyz"))
    return joined.withColumn("ball_gap", gap).withColumn("current", F.when(F.coalesce(gap <= REACH, F.lit(True)), F.col("holder")))


def _carried() -> Column:
    """Whether the ball lies on the holder, who is on no wall."""
    flat, rise = C.length(tuple(F.col(f"p{c}") - F.col(f"ball_{c}") for c in "xy")), F.col("ball_z") - F.col("pz")
    held = F.col("ball_z").between(CARRY_LOW, CARRY_HIGH) & (flat <= CARRY_GAP) & rise.between(0, CARRY_RISE) & ~on_wall()
    return F.coalesce(held, F.lit(False))


def on_wall() -> Column:
    return F.coalesce(on_surface(F.col("px"), F.col("py"), F.col("pz"))[0], F.lit(False))


def player_possessions(rows: DataFrame) -> DataFrame:
    """One row per possession of a player of at least two touches 0.12 s apart.

    rows: frames of play with match_id, stretch, frame, ms, dt_ms, ball_x, ball_y, ball_z, prev_ball_y, third, toucher0, toucher1, holder_team, and what within_reach adds. A possession is
    interrupted while nobody holds the ball or its holder is out of reach, and goes on if the same player has it again within 2 s with nobody else between. Times and distances count
    up to the last touch before each interruption, and before the end."""
    frame = temporal.ordered(KEYS, ["frame"])
    run = Window.partitionBy(*KEYS, "run")
    touched = F.coalesce((F.col("toucher0") == F.col("current")) | (F.col("toucher1") == F.col("current")), F.lit(False))
    rows = temporal.islands(rows, KEYS, ["frame"], F.col("current"), "run").withColumn("touched", touched)
    rows = rows.withColumn("counts", F.coalesce(F.col("frame") <= F.max(F.when(F.col("touched"), F.col("frame"))).over(run), F.lit(False)))
    rows = rows.withColumn("carried", _carried())
    rows = rows.withColumn("carry_begins", F.col("carried") & ~F.coalesce(F.lag("carried").over(temporal.ordered([*KEYS, "run"], ["frame"])), F.lit(False)))
    # Runs of one holder on either side of a short run without any are one possession: its number is that of its first run.
    first = rows.withColumn("run_ms", F.min("ms").over(run)).withColumn("before", F.lag("run").over(frame))
    starts = first.where(F.col("before").isNull() | (F.col("before") != F.col("run"))).select(*KEYS, "run", "current", "run_ms")
    by_run = temporal.ordered(KEYS, ["run"])
    resumed = (F.lag("run").over(by_run).isNotNull()) & F.lag("current").over(by_run).isNull() & (F.lag("current", 2).over(by_run) == F.col("current")) & (F.col("run_ms") - F.lag("run_ms").over(by_run) <= RESUME)
    # A run without a holder belongs to no possession, so it must not separate the two that it lies between.
    chained = temporal.segment(starts.withColumn("fresh", F.col("current").isNotNull() & ~F.coalesce(resumed, F.lit(False))), KEYS, ["run"], F.col("fresh"), "possession")
    rows = rows.join(chained.where("current IS NOT NULL").select(*KEYS, "run", "possession"), [*KEYS, "run"])
    by = [*KEYS, "possession"]
    forward = (F.col("ball_y") - F.col("prev_ball_y")) * F.when(F.col("holder_team") == 0, 1).otherwise(-1)
    counted = lambda c: F.coalesce(F.sum(F.when(F.col("counts"), c)), F.lit(0))
    totals = rows.groupBy(*by).agg(
        F.first("current").alias("player_id"),
        F.first("holder_team").alias("team"),
        F.greatest(F.min("frame") - 1, F.lit(0)).alias("start_frame"),
        F.max("frame").alias("end_frame"),
        F.greatest(F.min_by(F.col("ms") - F.col("dt_ms"), "frame"), F.lit(0)).alias("start_ms"),
        F.max("ms").alias("end_ms"),
        counted(F.col("dt_ms")).alias("duration_ms"),
        counted(F.when(F.col("ball_gap") <= CLOSE, F.col("dt_ms")).otherwise(0)).alias("close_ms"),
        counted(F.when(F.col("carried"), F.col("dt_ms")).otherwise(0)).alias("carry_ms"),
        F.sum(F.col("carry_begins").cast("long")).alias("carry_count"),
        counted(F.greatest(forward, F.lit(0.0))).alias("advance_distance"),
        counted(F.greatest(-forward, F.lit(0.0))).alias("retreat_distance"),
        F.min_by("third", "frame").alias("start_third"),
        F.max_by("third", F.when(F.col("third").isNotNull(), F.col("frame"))).alias("end_third"),
        F.count_distinct("run").alias("n_parts"),
    )
    hits = rows.where("touched").select(*by, "ms", "frame")
    apart = scans.scanned(hits, by, ["ms", "frame"], [], scans.rate_limit(TOUCH_APART), "match_id long, stretch long, possession long, ms long, frame long")
    kinds = apart.join(rows.select(*by, "frame", on_wall().alias("wall"), F.coalesce(F.col("pz") > GROUND_Z, F.lit(False)).alias("up")), [*by, "frame"]).groupBy(*by).agg(
        F.count("*").alias("touch_count"),
        F.sum(F.col("wall").cast("long")).alias("wall_touch_count"),
        F.sum((~F.col("wall") & F.col("up")).cast("long")).alias("aerial_touch_count"),
        (F.max("ms") - F.min("ms")).alias("touch_span_ms"),
    )
    sustained = (F.col("duration_ms") >= EPISODE_TIME) & (F.col("touch_span_ms") >= TOUCH_SPAN) & (F.col("close_ms") >= CLOSE_TIME)
    return totals.join(kinds, by).where(F.col("touch_count") >= LEAST_TOUCHES).withColumn("sustained_control", sustained).drop("touch_span_ms")
