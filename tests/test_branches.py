"""No query on recordings passes on nothing: each has rows on the tables that correctness is measured on, and the labels named here occur."""

import duckdb
import pytest

from kairoframe.plans import catalogue

LABELS = {
    "rec_goal_tags": ("tag", {"aerial", "high_aerial", "long_distance", "own_half", "empty_net", "counter_attack", "sustained_pressure", "one_timer", "passing", "half_volley", "flip_into_ball", "demo", "kickoff"}),
    "rec_goal_build_up": ("build_up", {"counter_attack", "sustained_pressure", "other"}),
    "rec_pass_kind": ("kind", {"direct", "wall"}),
    "rec_possession": ("state", {"team_zero", "team_one", "neutral"}),
    "rec_loose_possession": ("state", {"team_zero", "team_one", "neutral"}),
    "rec_dodge_reset": ("outcome", {"used", "landed", "expired", "superseded", "play_ended", "goal_scored", "recording_ended", None}),
    "rec_boost_pickup": ("detection", {"both", "reported_only", "inferred_only"}),
    "rec_touch_kind": ("kind", {"control", "medium", "hard"}),
    "live_lifecycle": ("lifecycle", {"confirmed", "finalized"}),
    "live_current": ("stream", {"demolition", "increment"}),
    "corpus_sweep": ("ok", {True, False}),
}
COUNTED = {
    "rec_player_possession": ["n_parts > 1", "sustained_control", "NOT sustained_control", "carry_count > 0", "wall_touch_count > 0", "aerial_touch_count > 0", "duration_ms < end_ms - start_ms"],
    "rec_boost_pickup": ["overfill > 0", "overfill = 0", "is_steal", "NOT is_steal"],
    "rec_possession": ["NOT active", "decided_frame > end_frame"],
    "rec_loose_possession": ["decided_frame > end_frame"],
    "rec_recent_reset": ["reset AND NOT reset_committed", "reset_committed", "NOT reset"],
    "rec_indicators": ["touch = 1", "pass = 1", "one_timer = 1", "double_tap = 1", "dodge = 1", "half_volley = 1", "demolition = 1", "backboard = 1"],
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(n for n in catalogue.ORACLES if n.startswith(("rec_", "live_", "corpus_"))))
def test_occurs(duck, name):
    rows = duck.sql(catalogue.ORACLES[name])
    assert rows.count("*").fetchall()[0][0] > 0
    if name in LABELS:
        column, labels = LABELS[name]
        assert {r[0] for r in rows.select(column).distinct().fetchall()} >= labels
    for condition in COUNTED.get(name, ()):
        assert rows.filter(condition).count("*").fetchall()[0][0] > 0, condition
