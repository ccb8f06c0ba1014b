"""Dodge resets on the ball, each pending until it is used, lands, is superseded or runs into a boundary; the outcome is written back to the reset.

A reset lives from the frame that grants it to its first ending, so no state is carried from frame to frame: rows are numbered by the last reset before them, what a
pending reset remembers (its dodge's onset, the latest touch, the last frame of a dodge) are running windows within that number, and the first ending is a minimum. Only one thing passes from
one reset to the next: whether a touch in the frame of a reset was used up by the one before. Both answers are worked out for each reset, and windows over the resets alone settle which holds.

rows(match_id, player_id, team, frame, ms, z, dodging, touched, touch_contact, refreshed, on_ball, goal, in_play): every frame of every player.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import temporal

# Milliseconds and uu.
SOONEST, LATEST, CONTINUES, LAGS, GROUNDED = 50, 2000, 350, 250, 80.0
LEAST_CAR_Z, LEAST_BALL_Z, FARTHEST, HIGHEST = 95.0, 80.0, 180.0, 140.0

PLAYER = ["match_id", "player_id"]
# The order in which a frame's endings are looked at.
GOAL, STOPPED, DODGE_AFTER_TOUCH, SAME_FRAME, SUPERSEDED, TOUCH, LANDED = range(7)


def on_ball(car: C.Vector, q: C.Vector, ball: C.Vector) -> Column:
    """Whether a car, turned by the unit quaternion q, has the ball close enough, and not above it."""
    away = C.subtract(ball, car)
    return (car[2] >= LEAST_CAR_Z) & (ball[2] >= LEAST_BALL_Z) & (C.length(away) <= FARTHEST) & (C.rotate(C.conjugate(q), away)[2] <= HIGHEST)


def _distinct(touch: Column, onset: Column, reset: Column | None = None) -> Column:
    """Whether a dodge begun at ``onset`` with a touch is another one than the reset's own contact."""
    reset = F.col("reset_ms") if reset is None else reset
    near = (onset - reset < SOONEST) & (touch["ms"] - reset < SOONEST)
    return ~near | touch["contact"]


def _use(touch: Column, onset: Column, reset: Column) -> Column:
    """What a confirmed touch leads to: outcome, when, and how long after the reset."""
    late = onset - reset > LATEST
    return F.struct(F.when(late, "expired").otherwise("used").alias("outcome"), touch["ms"].alias("ms"), touch["frame"].alias("frame"), F.when(~late, touch["ms"] - reset).alias("time_to_use"))


def _plain(outcome: str) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.col("ms"), F.col("frame"), F.lit(None).cast("long").alias("time_to_use"))


def _ending(frame: Column, order: int, what: Column) -> Column:
    return F.struct(frame.alias("at"), F.lit(order).alias("order"), what.alias("what"))


def _first(*endings: Column) -> Column:
    """The earliest of those that there are."""
    return F.array_min(F.array_compact(F.array(*endings)))


def remembered(rows: DataFrame) -> DataFrame:
    """rows with the number of the last reset (0: none yet) and what it remembers in each frame, as if its own frame's touch counted (``recent``) and as if not (``recent_used``)."""
    w = temporal.ordered(PLAYER, ["frame"])
    so_far = temporal.running(PLAYER, ["frame"])
    number = [*PLAYER, "number"]
    here, before = temporal.running(number, ["frame"]), temporal.ordered(number, ["frame"]).rowsBetween(Window.unboundedPreceding, -1)
    own = temporal.ordered(number, ["frame"])
    rows = rows.withColumn("armed", F.col("refreshed") & F.col("on_ball")).withColumn("edge", F.col("dodging") & ~F.lag("dodging", 1, False).over(w)).withColumn("active_ms", F.last(F.when(F.col("dodging"), F.col("ms")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("stopped", ~F.col("in_play") & F.lag("in_play", 1, True).over(w))
    rows = temporal.segment(rows, PLAYER, ["frame"], F.col("armed"), "number")
    touch = F.when(F.col("touched"), F.struct("ms", "frame", (F.col("touch_contact") | F.col("dodging")).alias("contact")))
    rows = rows.withColumn("touch", touch).withColumn("onset", F.last(F.when(F.col("edge") & ~F.col("armed"), F.col("ms")), ignorenulls=True).over(here))
    later = F.when(~F.col("armed"), F.col("touch"))
    rows = rows.withColumns({"recent": F.last("touch", ignorenulls=True).over(before), "recent_used": F.last(later, ignorenulls=True).over(before)})
    held = {"last_touch": F.last("touch", ignorenulls=True).over(here), "last_later": F.last(later, ignorenulls=True).over(here), "reset_ms": F.first("ms").over(own)}
    rows = rows.withColumns(held)
    # What the reset before this one remembered in the frame before: for the frame that grants another.
    carried = {f"old_{c}": F.lag(c).over(w) for c in ("onset", "last_touch", "last_later", "reset_ms")}
    return rows.withColumns(carried).withColumn("old_onset", F.when(F.col("edge"), F.col("ms")).otherwise(F.col("old_onset")))


def _dodging_at(onset: Column) -> Column:
    """Whether the dodge begun at ``onset`` still carries a touch in this frame."""
    return F.coalesce(((F.col("ms") - onset).between(0, CONTINUES)) | ((F.col("active_ms") >= onset) & (F.col("ms") - F.col("active_ms") <= LAGS)), F.lit(False))


def _dodge_after(touch: Column, reset: Column) -> Column:
    """The ending by a dodge that begins in this frame, soon after a touch."""
    ok = F.col("edge") & touch.isNotNull() & (F.col("ms") - touch["ms"] <= LAGS) & _distinct(touch, F.col("ms"), reset)
    return F.when(F.coalesce(ok, F.lit(False)), _ending(F.col("frame"), DODGE_AFTER_TOUCH, _use(touch, F.col("ms"), reset)))


def endings(rows: DataFrame) -> DataFrame:
    """One row per reset on the ball: match_id, player_id, number, its frame (``reset``), the last frame seen (``seen``), ``ended`` and ``ended_used``: its first ending before its successor's
    touch and the successor itself are looked at, without and with its own touch used up. Every frame says what it ends, of the last reset and, where it grants another, of the one before."""
    reset, touch, at = F.col("reset_ms"), F.col("touch"), F.col("frame")
    boundaries = [F.when(F.col("goal"), _ending(at, GOAL, _plain("goal_scored"))), F.when(F.col("stopped"), _ending(at, STOPPED, _plain("play_ended")))]
    touched = touch.isNotNull() & F.col("onset").isNotNull() & (touch["contact"] | _dodging_at(F.col("onset"))) & _distinct(touch, F.col("onset"))
    used = F.when(F.coalesce(touched, F.lit(False)), _ending(at, TOUCH, _use(touch, F.col("onset"), reset)))
    landed = F.when(F.col("z") <= GROUNDED, _ending(at, LANDED, _plain("landed")))
    inside = [_first(*boundaries, _dodge_after(F.col(c), reset), used, landed) for c in ("recent", "recent_used")]
    # A touch in the reset's own frame, in a dodge, uses it at once, if it is still to be had.
    at_once = F.when(F.coalesce(touch["contact"] & F.col("dodging"), F.lit(False)), _ending(at, TOUCH, _use(touch, F.col("ms"), reset)))
    old = [_first(*boundaries, _dodge_after(F.col(c), F.col("old_reset_ms"))) for c in ("old_last_touch", "old_last_later")]
    taken = touch.isNotNull() & (touch["contact"] | _dodging_at(F.col("old_onset"))) & _distinct(touch, F.coalesce("old_onset", "ms"), F.col("old_reset_ms"))
    took = F.coalesce((F.col("number") > 1) & taken, F.lit(False))
    granted = F.struct("frame", "ms", "team", took.alias("took"), F.when(took, _use(touch, F.coalesce("old_onset", "ms"), F.col("old_reset_ms"))).alias("take"))

    def says(number: Column, first: Column, second: Column, new: Column) -> Column:
        return F.struct(number.alias("number"), first.alias("ended"), second.alias("ended_used"), new.alias("reset"))

    armed = F.col("armed")
    mine = says(F.col("number"), F.when(armed, at_once).otherwise(inside[0]), F.when(~armed, inside[1]), F.when(armed, granted))
    of_old = F.when(armed & (F.col("number") > 1), says(F.col("number") - 1, *old, F.when(F.lit(False), granted)))
    every = rows.where("number > 0").select(*PLAYER, F.struct("frame", "ms").alias("seen"), F.inline(F.array_compact(F.array(mine, of_old))))
    return every.groupBy(*PLAYER, "number").agg(F.min("ended").alias("ended"), F.min("ended_used").alias("ended_used"), F.max("reset").alias("reset"), F.max("seen").alias("seen"))


def settled(resets: DataFrame) -> DataFrame:
    """Adds ``used_up``, whether the touch in a reset's own frame went to the one before, and ``open``, whether it is itself open when its successor's touch is looked at.

    A reset's touch is used up if the one before it takes it (``took``) and is open; whether it is itself open then may depend on that. So each reset makes of the openness before it either a constant, the
    same or the opposite, and the openness at each is the last constant, turned over as often as there are opposites since."""
    w = temporal.ordered(PLAYER, ["number"])
    still = lambda c: F.col("next_frame").isNotNull() & (F.col(c).isNull() | (F.struct(F.col(c)["at"], F.col(c)["order"]) > F.struct(F.col("next_frame").alias("at"), F.lit(DODGE_AFTER_TOUCH).alias("order"))))
    rows = resets.withColumn("next_frame", F.lead("reset.frame").over(w)).withColumns({"__a": still("ended"), "__b": still("ended_used"), "__took": F.col("reset.took")})
    fixed = ~F.col("__took") | (F.col("__a") == F.col("__b"))
    rows = temporal.segment(rows.withColumn("__fixed", fixed), PLAYER, ["number"], F.col("__fixed"), "__since")
    since = temporal.running([*PLAYER, "__since"], ["number"])
    turned = F.sum((~F.col("__fixed") & F.col("__a")).cast("int")).over(since)
    rows = rows.withColumn("open", (F.first("__a").over(since).cast("int") + turned) % 2 == 1)
    return rows.withColumn("used_up", F.col("__took") & F.coalesce(F.lag("open").over(w), F.lit(False))).drop("__a", "__b", "__took", "__fixed", "__since")


def dodge_resets(rows: DataFrame) -> DataFrame:
    """One row per dodge that is granted anew: match_id, player_id, team, frame, ms, on_ball, used, outcome, outcome_frame, outcome_ms, time_to_use (the last four null off the ball)."""
    resets = settled(endings(remembered(rows)))
    w = temporal.ordered(PLAYER, ["number"])
    none = F.lit(None).cast("long")
    moment = lambda outcome, at: F.struct(F.lit(outcome).alias("outcome"), at["ms"].alias("ms"), at["frame"].alias("frame"), none.alias("time_to_use"))
    after = F.lead("reset").over(w)
    at_next = F.when(after["took"], after["take"]).otherwise(moment("superseded", after))
    found = F.when(F.col("used_up"), F.col("ended_used")).otherwise(F.col("ended"))
    last = F.max("seen").over(Window.partitionBy(*PLAYER))
    what = F.when(F.col("open"), at_next).otherwise(F.coalesce(found["what"], moment("recording_ended", last)))
    judged = resets.select(*PLAYER, "reset.team", "reset.frame", "reset.ms", F.lit(True).alias("on_ball"), what.alias("what"))
    columns = [*PLAYER, "team", "frame", "ms", "on_ball"]
    off = rows.where("refreshed AND NOT on_ball").select(*columns)
    out = judged.select(*columns, F.col("what.outcome").alias("outcome"), F.col("what.frame").alias("outcome_frame"), F.col("what.ms").alias("outcome_ms"), F.col("what.time_to_use").alias("time_to_use"))
    return out.unionByName(off, allowMissingColumns=True).withColumn("used", F.coalesce(F.col("outcome") == "used", F.lit(False)))


def recently(points: DataFrame, events: DataFrame, window: int, name: str) -> DataFrame:
    """points(match_id, player_id, ms, ...) with whether the player had one of the events (match_id, player_id, ms, committed) in the ``window`` before, the moment itself included: ``name`` counts those
    that are still pending too, ``name``_committed only those that will not be taken back."""
    marks = events.select(*PLAYER, "ms", F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.col("ms").alias("__any"), F.when(F.col("committed"), F.col("ms")).alias("__sure"))
    asked = points.select(*PLAYER, "ms", F.lit(1).alias("__side"), F.struct(*points.columns).alias("__row"), F.lit(None).alias("__any"), F.lit(None).alias("__sure"))
    w = Window.partitionBy(*PLAYER).orderBy("ms", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.withColumn("__row", F.col("__row").cast(asked.schema["__row"].dataType)).unionByName(asked).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("__any", "__sure")}).where("__side = 1")
    near = lambda c: F.coalesce(F.col("ms") - F.col(c) <= window, F.lit(False))
    return seen.select("__row.*", near("__any").alias(name), near("__sure").alias(f"{name}_committed"))
