"""Dodge resets on small hand-made recordings: one case for each way in which a reset ends."""

import pytest

from kairoframe.operators import resets as R

SCHEMA = "match_id long, player_id long, team int, frame long, ms long, z double, dodging boolean, touched boolean, touch_contact boolean, refreshed boolean, on_ball boolean, goal boolean, in_play boolean"


def run(spark, n=40, player=1, **at):
    """A player in the air for n frames of 0.1 s; at: the frames of each flag."""
    rows = []
    for f in range(1, n + 1):
        has = lambda c, default=(): f in at.get(c, default)  # noqa: B023, E731
        rows.append((1, player, 0, f, f * 100, 50.0 if has("ground") else 500.0, has("dodging"), has("touched") or has("contact"), has("contact"), has("reset") or has("off"), has("reset"), has("goal"), not has("idle")))
    found = R.dodge_resets(spark.createDataFrame(rows, SCHEMA)).orderBy("frame").collect()
    return [(r.frame, r.outcome, r.outcome_frame, r.time_to_use) for r in found]


def test_used_by_a_dodge_into_the_ball(spark):
    assert run(spark, reset=[5], dodging=[8, 9], touched=[9]) == [(5, "used", 9, 400)]
    # The touch may come shortly after the dodge has ended, and the dodge shortly after the touch.
    assert run(spark, reset=[5], dodging=[8], touched=[10]) == [(5, "used", 10, 500)]
    assert run(spark, reset=[5], dodging=[9], touched=[8]) == [(5, "used", 8, 300)]
    assert run(spark, reset=[5], dodging=[12], touched=[8]) == [(5, "recording_ended", 40, None)]
    # A touch without a dodge, or with one begun before the reset, uses nothing.
    assert run(spark, reset=[5], touched=[9], ground=[20]) == [(5, "landed", 20, None)]
    assert run(spark, reset=[5], dodging=[3, 4, 5, 6], touched=[9], ground=[20]) == [(5, "landed", 20, None)]


def test_in_the_resets_own_frame(spark):
    assert run(spark, reset=[5], dodging=[4, 5], touched=[5]) == [(5, "used", 5, 0)]
    assert run(spark, reset=[5], touched=[5], ground=[7]) == [(5, "landed", 7, None)]


def test_too_late(spark):
    assert run(spark, reset=[5], dodging=[26], touched=[26]) == [(5, "expired", 26, None)]
    assert run(spark, reset=[5], dodging=[25], touched=[25]) == [(5, "used", 25, 2000)]


def test_boundaries_come_first(spark):
    assert run(spark, reset=[5], dodging=[8], touched=[8], goal=[8]) == [(5, "goal_scored", 8, None)]
    assert run(spark, reset=[5], idle=[7, 8], ground=[9]) == [(5, "play_ended", 7, None)]
    assert run(spark, reset=[5], goal=[6], idle=[6]) == [(5, "goal_scored", 6, None)]
    # A boundary in the frame of the reset comes before it.
    assert run(spark, reset=[5], goal=[5]) == [(5, "recording_ended", 40, None)]


def test_superseded_or_used_by_the_touch_that_grants_the_next(spark):
    assert run(spark, reset=[5, 9], ground=[12]) == [(5, "superseded", 9, None), (9, "landed", 12, None)]
    assert run(spark, reset=[5, 9], dodging=[8, 9], touched=[9], ground=[12]) == [(5, "used", 9, 400), (9, "landed", 12, None)]
    # That touch went to the first: the second is not used by it. Without a first, it is.
    assert run(spark, reset=[9], dodging=[8, 9], touched=[9], ground=[12]) == [(9, "used", 9, 0)]
    # A third: the touch in its frame goes to the second, which was still open.
    assert run(spark, reset=[5, 9, 13], dodging=[8, 9, 12, 13], touched=[9, 13], ground=[20]) == [(5, "used", 9, 400), (9, "used", 13, 400), (13, "landed", 20, None)]
    # The first had landed, so its successor gets the touch.
    assert run(spark, reset=[5, 9], ground=[7], dodging=[8, 9], touched=[9]) == [(5, "landed", 7, None), (9, "used", 9, 0)]


def test_off_the_ball_has_no_outcome_and_players_are_apart(spark):
    assert run(spark, off=[3], reset=[5], ground=[7]) == [(3, None, None, None), (5, "landed", 7, None)]
    assert run(spark) == []


@pytest.mark.parametrize("window,want", [(300, [False, True, True, False]), (1000, [False, True, True, True])])
def test_recently(spark, window, want):
    events = spark.createDataFrame([(1, 1, 500, False), (1, 1, 200, True), (1, 2, 800, True)], "match_id long, player_id long, ms long, committed boolean")
    points = spark.createDataFrame([(1, 1, t) for t in (100, 500, 700, 900)], "match_id long, player_id long, ms long")
    found = R.recently(points, events, window, "reset").orderBy("ms").collect()
    assert [r.reset for r in found] == want
    assert [r.reset_committed for r in found] == [False, True, window == 1000, window == 1000]
    assert R.recently(points, events.where("false"), window, "reset").where("reset").collect() == []
