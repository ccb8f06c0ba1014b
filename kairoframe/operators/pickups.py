"""Boost pickups: what the pads report and what the jumps of a player's boost show, matched with each other.

Two queues wait for each other: a report takes the nearest waiting jump of its player within three frames whose kind of pad fits (an ambiguous jump fits any), and the other way round; each is used once, the
earlier of two equally near ones first. So a pickup is known from both, from the report only or from the jump only. It is a scan over a player's reports and jumps, of which only those of
the last three frames wait.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.operators import scans, temporal
from kairoframe.operators.detectors import normalised_y
from kairoframe.operators.scans import Scan

# Frames, and boost in raw units (255 are full).
BAND, FULL, SMALL = 3, 255.0, 30.6
BIG_PAD, SMALL_PAD, ANY_PAD = 1, 0, -1
PLAYER = ["match_id", "player_id"]


def two_queues(band: int) -> Scan:
    """Columns frame, id, source (0, 1), kind (-1: any): adds ``partner``, the id of the row of the other source that a row takes (-1: none). A row takes the nearest waiting one of the other source and of a fitting
    kind that is at most ``band`` away; what is taken waits no longer. State: the waiting rows, the oldest first."""

    def scan(waiting, columns):
        waiting, partner = list(waiting or ()), np.full(len(columns[0]), -1)
        for i, (frame, id_, source, kind) in enumerate(zip(*(c.tolist() for c in columns))):
            waiting = [w for w in waiting if frame - w[0] <= band]
            fitting = [w for w in waiting if w[2] != source and (w[3] == kind or ANY_PAD in (w[3], kind))]
            if fitting:
                taken = min(fitting, key=lambda w: frame - w[0])
                waiting.remove(taken)
                partner[i] = taken[1]
            else:
                waiting.append((frame, id_, source, kind))
        return waiting, np.arange(len(partner)), [partner]

    return scan


def boost_pickups(reports: DataFrame, jumps: DataFrame) -> DataFrame:
    """reports(match_id, player_id, frame, kind) and jumps(match_id, player_id, frame, kind, before, after, y, team), before and after in raw units: one row per pickup: frame (of the jump where there is
    one), kind, detection (both, reported_only, inferred_only), collected, overfill (what the pad held beyond a full tank) and is_steal (on the other team's half). Amounts are null without a jump."""
    kinds = {"before": "double", "after": "double", "y": "double", "team": "int"}
    rows = reports.select(*PLAYER, "frame", "kind", F.lit(0).alias("source"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).unionByName(jumps.select(*PLAYER, "frame", "kind", F.lit(1).alias("source"), *kinds))
    rows = rows.withColumn("id", F.row_number().over(temporal.ordered(PLAYER, ["frame", "source", "kind", "before", "y"])).cast("long"))
    matched = scans.scanned(rows, PLAYER, ["frame", "id"], ["source", "kind"], two_queues(BAND), "match_id long, player_id long, frame long, id long, partner long")
    # A pair is told by its later row: both become one group, named by the earlier one's id.
    pairs = matched.select(*PLAYER, "id", F.when(F.col("partner") >= 0, F.col("partner")).otherwise(F.col("id")).alias("pickup"))
    jump = lambda c: F.max(F.when(F.col("source") == 1, F.col(c)))
    found = rows.join(pairs, [*PLAYER, "id"]).groupBy(*PLAYER, "pickup").agg(
        F.count_distinct("source").alias("__n"), F.max("source").alias("__source"), F.coalesce(jump("frame"), F.max("frame")).alias("frame"), F.coalesce(F.max(F.when(F.col("kind") >= 0, F.col("kind"))), F.lit(BIG_PAD)).alias("kind"), *(jump(c).alias(c) for c in kinds)
    )
    nominal = F.when(F.col("kind") == BIG_PAD, FULL).otherwise(SMALL)
    collected = F.when(F.col("before").isNotNull(), F.least(nominal, F.lit(FULL) - F.col("before")))
    detection = F.when(F.col("__n") == 2, "both").when(F.col("__source") == 0, "reported_only").otherwise("inferred_only")
    return found.select(*PLAYER, "frame", "kind", detection.alias("detection"), collected.alias("collected"), (nominal - collected).alias("overfill"), _steal().alias("is_steal"))


def _steal() -> Column:
    return normalised_y(F.col("y"), F.col("team")) > 0
