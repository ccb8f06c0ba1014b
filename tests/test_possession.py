"""Possession against frame-by-frame rules written out plainly."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.operators import possession as P


def strict(frames, end):
    """Segments of one stretch: frames of (ms, toucher0, toucher1); end: the ms of the frame after it, or None where the recording ends."""
    opened, out = frames[0][0], []
    phase, team, player, last, rival, rival_player = "neutral", None, None, None, None, None

    def close(at, t, p):
        nonlocal opened
        if at > opened:
            out.append((opened, at, t, p))
        opened = at

    for ms, *by in frames:
        who = [i for i in (0, 1) if by[i] is not None]
        if phase == "neutral":
            if len(who) == 1:
                phase, team, player, last = "acquiring", who[0], by[who[0]], ms
        elif phase == "acquiring":
            if not who and ms - last > 3000:
                phase = "neutral"
            elif who == [team]:
                close(last, -1, None)
                phase, player, last = "held", by[team], ms
            elif len(who) == 1:
                team, player, last = who[0], by[who[0]], ms
        elif not who:
            if ms - (rival if phase == "challenged" else last) > 3000:
                close(last, team, player)
                phase = "neutral"
        elif who == [team]:
            phase, player, last = "held", by[team], ms
        elif phase == "held":
            if len(who) == 2:
                player, last = by[team], ms
            phase, rival, rival_player = "challenged", ms, by[1 - team]
        else:
            close(last, team, player)
            close(rival, -1, None)
            phase, team, player, last = "held", 1 - team, by[1 - team], ms
    held = phase in ("held", "challenged")
    if end is None:
        close(frames[-1][0], team if held else -1, player if held else None)
    else:
        if held:
            close(last, team, player)
        close(end, -1, None)
    return out


def loose(frames, end):
    opened, out, team, player, rival, rival_player = frames[0][0], [], None, None, None, None

    def close(at, t, p):
        nonlocal opened
        if at > opened:
            out.append((opened, at, t, p))
        opened = at

    for ms, *by in frames:
        who = [i for i in (0, 1) if by[i] is not None]
        if team is None:
            if len(who) == 1:
                close(ms, -1, None)
                team, player = who[0], by[who[0]]
        elif who == [team]:
            player, rival = by[team], None
        elif rival is None and who:
            if len(who) == 2:
                player = by[team]
            rival, rival_player = ms, by[1 - team]
        elif rival is not None and (len(who) == 1 or (not who and ms - rival > 1500)):
            close(rival, team, player)
            team, player, rival = 1 - team, by[1 - team] if who else rival_player, None
    close(frames[-1][0] if end is None else end, -1 if team is None else team, player)
    return out


def holders(frames):
    team = player = last = pending = None
    for ms, *by in frames:
        if pending is not None:
            if ms - pending >= 1250:
                team = player = last = pending = None
        elif last is not None and ms - last >= 3000:
            team = player = last = None
        who = [i for i in (0, 1) if by[i] is not None]
        if len(who) == 2:
            player, pending = None, ms if team is not None else None
            last = ms if team is not None else last
        elif who:
            if team in (None, who[0]) or pending is not None:
                team, player, last, pending = who[0], by[who[0]], ms, None
            else:
                player, pending = None, ms
        yield (-1 if team is None else team, -1 if player is None else player)


def stretch(seed):
    r = random.Random(seed)
    often = r.choice([0.03, 0.1, 0.3, 0.6])
    frames, ms = [], r.randrange(1000)
    for _ in range(r.randint(1, 160)):
        both = r.random() < 0.15
        first = r.randrange(2)
        touch = r.random() < often
        frames.append((ms, *(10 * i + r.randrange(3) if touch and (both or i == first) else None for i in (0, 1))))
        ms += r.choice([0, 40, 100, 100, 250, 1250, 1500, 3000] if r.random() < 0.1 else [100])
    return frames, r.choice([None, ms])


def columns(frames, end):
    n = len(frames)
    ms, zero, one = (np.array([-1 if f[i] is None else f[i] for f in frames], np.int64) for i in range(3))
    end_ms, end_frame = np.full(n, -1), np.full(n, -2)
    end_ms[-1], end_frame[-1] = (-1, -1) if end is None else (end, n + 1)
    return [np.arange(1, n + 1), ms, zero, one, end_ms, end_frame]


def shares(scan, arrays, cuts):
    """A scan in shares, as batches bring them."""
    state, out = None, []
    for a, b in zip([0, *cuts], [*cuts, len(arrays[0])]):
        if b > a:
            state, rows, more = scan(state, [x[a:b] for x in arrays])
            out += zip((rows + a).tolist(), *(m.tolist() for m in more))
    return out


@pytest.mark.parametrize("name", ["strict", "loose"])
def test_segments_against_frames(name):
    plain = {"strict": strict, "loose": loose}[name]
    scan = P.resolver(*(getattr(P, f"{name}_{part}") for part in ("touch", "lapse", "flush")))
    seen = set()
    for seed in range(600):
        frames, end = stretch(seed)
        got = shares(scan, columns(frames, end), sorted(random.Random(seed).choices(range(len(frames) + 1), k=seed % 4)))
        want = plain(frames, end)
        assert [(s, e, t, None if p < 0 else p) for _, s, _, e, _, t, p in got] == want, seed
        # Segments follow each other without a gap, and none is decided before it ends.
        assert all(a[3] == b[1] for a, b in zip(got, got[1:]))
        assert all(frames[row][0] >= e or row == len(frames) - 1 for row, _, _, e, *_ in got)
        seen |= {t for _, _, t, _ in want}
    assert seen == {-1, 0, 1}


def test_holders_against_frames():
    for seed in range(600):
        frames, end = stretch(seed)
        got = shares(P.control(), columns(frames, end), sorted(random.Random(seed).choices(range(len(frames) + 1), k=seed % 4)))
        assert [(t, p) for _, t, p in got] == list(holders(frames)), seed


def rows_of(spark, cases):
    """cases: (match, frame, toucher0, toucher1, holder, ball_gap, ball_y): frames of one stretch, 0.1 s apart."""
    schema = "match_id long, stretch long, frame long, ms long, dt_ms long, ball_x double, ball_y double, ball_z double, prev_ball_y double, third string, toucher0 long, toucher1 long, holder_team long, holder long"
    rows, before = [], {}
    for m, f, a, b, holder, gap, y in cases:
        rows.append((m, 1, f, f * 100, 100, 0.0, y, 500.0, before.get(m), "middle" if abs(y) < 2300 else None, a, b, None if holder is None else holder % 2, holder))
        before[m] = y
    players = [(m, f, h, float(gap), y, 500.0) for m, f, _, _, h, gap, y in cases if h is not None and gap is not None]
    return P.within_reach(spark.createDataFrame(rows, schema), spark.createDataFrame(players, "match_id long, frame long, player_id long, x double, y double, z double"))


def possessions(spark, cases):
    return [r.asDict() for r in P.player_possessions(rows_of(spark, cases)).orderBy("match_id", "start_frame").collect()]


def test_what_follows_the_last_touch_is_taken_back(spark):
    cases = [(1, f, 2 if f in (1, 5, 9) else None, None, 2 if f <= 20 else None, 300, 100.0 * f if f <= 9 else 900.0 - 50 * (f - 9)) for f in range(1, 25)]
    (one,) = possessions(spark, cases)
    assert (one["start_frame"], one["end_frame"], one["duration_ms"], one["close_ms"], one["touch_count"]) == (0, 20, 900, 900, 3)
    assert one["advance_distance"] == 800 and one["retreat_distance"] == 0  # the way back came after the last touch


def test_resumed_within_two_seconds_and_not_after(spark):
    def gap(frames):
        n = 6 + frames
        return [(1, f, 2 if f in (1, 4, n, n + 3) else None, None, 2 if f <= 5 or f >= n else None, 100, 0.0) for f in range(1, n + 6)]

    (one,) = possessions(spark, gap(20))  # suspended at frame 6, resumed at 26: 2.0 s
    assert (one["n_parts"], one["duration_ms"], one["touch_count"]) == (2, 800, 4)
    two = possessions(spark, gap(21))
    assert [(p["n_parts"], p["duration_ms"], p["touch_count"]) for p in two] == [(1, 400, 2), (1, 400, 2)]


def test_another_holder_ends_it_and_one_touch_is_none(spark):
    cases = [(1, f, 2 if f in (1, 3, 12, 14) else None, 3 if f == 7 else None, 2 if f < 5 or f > 9 else 3 if f == 7 else None, 100, 0.0) for f in range(1, 16)]
    found = possessions(spark, cases)
    assert [(p["player_id"], p["start_frame"], p["end_frame"]) for p in found] == [(2, 0, 4), (2, 9, 15)]


def test_touches_too_near_and_a_ball_out_of_reach(spark):
    cases = [(1, f, 2 if f <= 3 else None, None, 2, 100, 0.0) for f in range(1, 6)]  # touches at 0.1, 0.2 and 0.3 s: the second is too near the first
    assert [p["touch_count"] for p in possessions(spark, cases)] == [2]
    cases = [(1, f, 2 if f in (1, 4, 20) else None, None, 2, 2600 if 8 <= f < 15 else None if f == 16 else 100, 0.0) for f in range(1, 22)]
    (one,) = possessions(spark, cases)  # out of reach for a while, an unknown place counts as in reach
    assert (one["n_parts"], one["touch_count"], one["duration_ms"]) == (2, 3, 400 + 600)
    assert possessions(spark, []) == []


def test_stoppages_stand_between(spark):
    rows = spark.createDataFrame([(1, 1, f, f * 100, None, 3 if f in (2, 3) else None, *((500, 5) if f == 4 else (None, None))) for f in range(1, 5)], "match_id long, stretch long, frame long, ms long, toucher0 long, toucher1 long, end_ms long, end_frame long")
    idle = spark.createDataFrame([(1, 2, 5, 500), (1, 2, 6, 600)], "match_id long, stretch long, frame long, ms long")
    found = P.with_stoppages(P.strict_possessions(rows), idle).orderBy("start_ms").select("start_ms", "end_ms", "state", "active").collect()
    assert [tuple(r) for r in found] == [(100, 200, "neutral", True), (200, 300, "team_one", True), (300, 500, "neutral", True), (500, 600, "neutral", False)]
    assert P.loose_possessions(rows.where(F.lit(False))).collect() == []
