"""Half flips: dodges that turn a car's nose around and keep it there.

A candidate lives from a dodge's first frame to its evaluation 0.65 s later, unless another dodge or a stoppage comes first. What it has to know then are prefix scans over its frames: the best
reversal so far, and the least reversal since the best one had first reached what is asked, a minimum under a condition that is itself a running maximum.

rows(match_id, player_id, team, frame, ms, in_play, dodging, fx, fy, fz, vx, vy, spin): every frame of every player; f: the nose's unit vector, spin: how fast the car turns, in hundredths of rad/s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import temporal

# Fixed values.
EVALUATED, REVERSAL, RETAINED, HORIZONTAL, VERTICAL, CONFIDENCE = 650, 0.75, 0.45, 0.55, 0.55, 0.55
TUMBLE_SPIN, TUMBLE_VERTICAL, BACKWARD_ENTRY = 250.0, 0.5, 0.0
LEAST_SQUARE = 1.1920929e-07

PLAYER = ["match_id", "player_id"]
CANDIDATE = [*PLAYER, "stretch", "number"]


def nose(q: C.Vector) -> C.Vector:
    """Where a car turned by the unit quaternion q points."""
    return C.rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))


def _direction(x: Column, y: Column) -> tuple[Column, Column]:
    """The unit vector along (x, y), or zeros."""
    size = F.sqrt(x * x + y * y)
    return tuple(F.when(size > 0, c / size).otherwise(F.lit(0.0)) for c in (x, y))


def half_flips(rows: DataFrame) -> DataFrame:
    """match_id, player_id, team, start_frame, frame (of the evaluation), reversal, vertical, backward_entry, reorientation, confidence."""
    w, so_far = temporal.ordered(PLAYER, ["frame"]), temporal.running(PLAYER, ["frame"])
    last = F.max("frame").over(temporal.Window.partitionBy("match_id"))
    rows = temporal.islands(rows.withColumn("last_frame", last), PLAYER, ["frame"], F.col("in_play"), "stretch").where("in_play").drop("state")
    flat, speed = F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2), F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    (nx, ny), (ux, uy) = _direction(F.col("fx"), F.col("fy")), _direction(F.col("vx"), F.col("vy"))
    rows = rows.withColumns({"flat": flat, "nx": nx, "ny": ny, "ux": ux, "uy": uy, "moving": speed * speed > LEAST_SQUARE})
    calm = F.when(~F.col("dodging"), F.struct("spin", F.abs("fz").alias("vertical")))
    rows = rows.withColumns({"calm": F.last(calm, ignorenulls=True).over(so_far.rowsBetween(temporal.Window.unboundedPreceding, -1)), "begins": F.col("dodging") & ~F.lag("dodging", 1, False).over(w) & (flat * flat > LEAST_SQUARE)})
    rows = temporal.segment(rows, PLAYER, ["frame"], F.col("begins"), "number").where("number > 0")
    here, own = temporal.running(CANDIDATE, ["frame"]), temporal.ordered(CANDIDATE, ["frame"])
    start = F.first(F.struct("ms", "frame", "nx", "ny", "ux", "uy", "moving", "calm", "begins")).over(own)
    rows = rows.withColumn("start", start).where("start.begins")  # after a stoppage nothing is left of a candidate
    seen = F.col("flat") >= HORIZONTAL
    rows = rows.withColumn("reversal_now", F.when(seen, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -(F.col("start.nx") * F.col("nx") + F.col("start.ny") * F.col("ny"))))))
    rows = rows.withColumns({
        "reversal": F.coalesce(F.last("reversal_now", ignorenulls=True).over(here), F.lit(0.0)),
        "best": F.greatest(F.lit(0.0), F.coalesce(F.max("reversal_now").over(here), F.lit(0.0))),
        "vertical": F.max(F.abs("fz")).over(here),
        "reorientation": F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(seen & F.col("moving"), F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy"))).over(here), F.lit(0.0))),
    })
    # The least reversal from the frame on in which the best one reached the level.
    rows = rows.withColumn("retained", F.least(F.lit(1.0), F.coalesce(F.min(F.when(F.col("best") >= REVERSAL, F.col("reversal_now"))).over(here), F.lit(1.0))))
    due = F.col("ms") - F.col("start.ms") >= EVALUATED
    rows = rows.withColumn("evaluated", (due & ~F.coalesce(F.lag(due).over(own), F.lit(False))) | (~due & (F.col("frame") == F.col("last_frame")))).where("evaluated")
    entry = F.when(F.col("start.moving"), -(F.col("start.nx") * F.col("start.ux") + F.col("start.ny") * F.col("start.uy"))).otherwise(0.0)
    confidence = C.unit_score(F.col("reversal"), REVERSAL, 0.98) * 0.75 + C.unit_score(F.col("vertical"), VERTICAL, 0.85) * 0.25
    tumbling = F.coalesce((F.col("start.calm.spin") >= TUMBLE_SPIN) | (F.col("start.calm.vertical") >= TUMBLE_VERTICAL), F.lit(False))
    judged = rows.withColumns({"backward_entry": entry, "confidence": confidence, "tumbling": tumbling})
    good = (F.col("reversal") >= REVERSAL) & (F.col("retained") >= RETAINED) & (F.col("flat") >= HORIZONTAL) & (F.col("vertical") >= VERTICAL) & (F.col("confidence") >= CONFIDENCE)
    kept = judged.where(good & ~(F.col("tumbling") & (F.col("backward_entry") < BACKWARD_ENTRY)))
    return kept.select(*PLAYER, "team", F.col("start.frame").alias("start_frame"), "frame", F.col("best").alias("reversal"), "vertical", "backward_entry", "reorientation", "confidence")
