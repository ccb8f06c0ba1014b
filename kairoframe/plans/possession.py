"""Queries of possession, dodge resets and half flips (operators/possession.py, resets.py, half_flips.py), each with plain SQL, frame by frame where one decides on the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import half_flips as H
from kairoframe.operators import possession as P
from kairoframe.operators import resets as R
from kairoframe.plans.registry import query
from kairoframe.sources import recordings
from kairoframe.sources.recordings import SQL_FLIP, SQL_FRAMES, SQL_PLAY, SQL_PLAYERS, SQL_RESET, STRAYED

PY = f"WITH RECURSIVE {SQL_FRAMES}, {SQL_PLAY}, n AS (SELECT * FROM py WHERE in_play)"


def play(spark, folder):
    return recordings.play(recordings.frames(spark, folder))


# A resolver's state: ph (0 neutral, 1 acquiring, 2 held, 3 challenged), tm, pl, the last touch l_, the rival's first touch c_; em: the ends that a frame decides.
_ONE, _BOTH, _NOW = "(n.toucher0 IS NULL) <> (n.toucher1 IS NULL)", "n.toucher0 IS NOT NULL AND n.toucher1 IS NOT NULL", "n.ms AS b_ms, n.frame AS b_fr"
_SEEN = f"""SELECT f.*, n.ms, n.frame, n.rn AS nrn, n.end_ms, n.end_frame, CASE WHEN {_ONE} THEN 1 WHEN {_BOTH} THEN 2 ELSE 0 END AS kind, CASE WHEN n.toucher0 IS NULL THEN 1 ELSE 0 END AS tt, coalesce(n.toucher0, n.toucher1) AS tp,
  CASE WHEN f.tm = 0 THEN n.toucher0 ELSE n.toucher1 END AS mine, CASE WHEN f.tm = 0 THEN n.toucher1 ELSE n.toucher0 END AS theirs FROM f JOIN n ON n.match_id = f.match_id AND n.stretch = f.stretch AND n.rn = f.rn + 1"""


def _end(ms: str, frame: str, team: str, player: str) -> str:
    return f"{{'ms': CAST({ms} AS BIGINT), 'frame': CAST({frame} AS BIGINT), 'team': CAST({team} AS INTEGER), 'player': CAST({player} AS BIGINT)}}"


_NONE = f"list_filter([{_end('0', '0', '0', '0')}], lambda x: false)"
_HELD, _NEUTRAL = _end("l_ms", "l_fr", "tm", "pl"), _end("c_ms", "c_fr", "-1", "NULL")


def resolved_sql(cases: list[tuple[str, str, dict[str, str], list[str]]], flushed: str, start: str) -> str:
    """A recursive query over frames. cases: (phase, condition, what changes in the state, what ends)."""
    columns = ["ph", "tm", "pl", "l_ms", "l_fr", "c_ms", "c_fr", "c_pl"]
    when = {c: " ".join(f"WHEN ph = {p} AND ({on}) THEN {new.get(c, c)}" for p, on, new, _ in cases) for c in columns}
    ends = " ".join(f"WHEN ph = {p} AND ({on}) THEN {'[' + ', '.join(e) + ']' if e else _NONE}" for p, on, _, e in cases)
    step = ", ".join(f"CASE {when[c]} ELSE {c} END AS {c}" for c in columns)
    return f"""f AS (
  SELECT match_id, stretch, CAST(0 AS BIGINT) AS rn, {start}, CAST(0 AS BIGINT) AS fr, CAST(NULL AS BIGINT) AS e_ms, CAST(NULL AS BIGINT) AS e_fr, CAST(NULL AS BIGINT) AS n_ms, {_NONE} AS em FROM n WHERE rn = 1
  UNION ALL
  SELECT match_id, stretch, nrn, {step}, frame, end_ms, end_frame, ms, CASE {ends} ELSE {_NONE} END FROM ({_SEEN})),
al AS (SELECT match_id, stretch, fr, em FROM f WHERE rn > 0 UNION ALL
  SELECT match_id, stretch, fr, CASE WHEN e_ms >= 0 THEN {flushed} ELSE [{_end('n_ms', 'fr', 'CASE WHEN ph >= 2 THEN tm ELSE -1 END', 'CASE WHEN ph >= 2 THEN pl END')}] END FROM f WHERE e_ms IS NOT NULL),
ex AS (SELECT match_id, stretch, fr, unnest(em) AS e, generate_subscripts(em, 1) AS num, len(em) AS n_em FROM al),
sg AS (SELECT *, coalesce(lag(e.ms) OVER w, s0) AS s_ms, coalesce(lag(e.frame) OVER w, s0f) AS s_fr FROM ex JOIN (SELECT match_id, stretch, ms AS s0, frame AS s0f FROM n WHERE rn = 1) USING (match_id, stretch)
  WINDOW w AS (PARTITION BY match_id, stretch ORDER BY e.ms, fr, num)),
sp AS (SELECT match_id, stretch, s_ms AS start_ms, s_fr AS start_frame, e.ms AS end_ms, e.frame AS end_frame, CASE e.team WHEN 0 THEN 'team_zero' WHEN 1 THEN 'team_one' ELSE 'neutral' END AS state, e.player AS player_id, fr AS decided_frame FROM sg WHERE e.ms > s_ms)"""


_START = "0 AS ph, -1 AS tm, CAST(NULL AS BIGINT) AS pl, CAST(0 AS BIGINT) AS l_ms, CAST(0 AS BIGINT) AS l_fr, CAST(0 AS BIGINT) AS c_ms, CAST(0 AS BIGINT) AS c_fr, CAST(NULL AS BIGINT) AS c_pl"
_TOUCH = {"l_ms": "ms", "l_fr": "frame"}
_CHALLENGE = [
    (2, "kind = 1 AND tt = tm", {"pl": "coalesce(tp, pl)", **_TOUCH}, []),
    (2, "kind = 1", {"ph": "3", "c_ms": "ms", "c_fr": "frame", "c_pl": "tp"}, []),
    (2, "kind = 2", {"ph": "3", "pl": "coalesce(mine, pl)", **_TOUCH, "c_ms": "ms", "c_fr": "frame", "c_pl": "theirs"}, []),
    (3, "kind = 1 AND tt = tm", {"ph": "2", "pl": "coalesce(tp, pl)", **_TOUCH}, []),
]
SQL_STRICT = resolved_sql(
    [
        (0, "kind = 1", {"ph": "1", "tm": "tt", "pl": "tp", **_TOUCH}, []),
        (1, "kind = 0 AND ms - l_ms > 3000", {"ph": "0"}, []),
        (1, "kind = 1 AND tt = tm", {"ph": "2", "pl": "coalesce(tp, pl)", **_TOUCH}, [_end("l_ms", "l_fr", "-1", "NULL")]),
        (1, "kind = 1", {"tm": "tt", "pl": "tp", **_TOUCH}, []),
        (2, "kind = 0 AND ms - l_ms > 3000", {"ph": "0"}, [_HELD]),
        *_CHALLENGE,
        (3, "kind = 0 AND ms - c_ms > 3000", {"ph": "0"}, [_HELD]),
        (3, "kind > 0", {"ph": "2", "tm": "1 - tm", "pl": "coalesce(theirs, c_pl)", **_TOUCH}, [_HELD, _NEUTRAL]),
    ],
    f"CASE WHEN ph >= 2 THEN [{_HELD}, {_end('e_ms', 'e_fr', '-1', 'NULL')}] ELSE [{_end('e_ms', 'e_fr', '-1', 'NULL')}] END",
    _START,
)
_TAKEN = _end("c_ms", "c_fr", "tm", "pl")
SQL_LOOSE = resolved_sql(
    [
        (0, "kind = 1", {"ph": "2", "tm": "tt", "pl": "tp", **_TOUCH}, [_end("ms", "frame", "-1", "NULL")]),
        *_CHALLENGE,
        (3, "kind = 0 AND ms - c_ms > 1500", {"ph": "2", "tm": "1 - tm", "pl": "c_pl"}, [_TAKEN]),
        (3, "kind = 1", {"ph": "2", "tm": "tt", "pl": "coalesce(tp, c_pl)", **_TOUCH}, [_TAKEN]),
    ],
    f"[{_end('e_ms', 'e_fr', 'CASE WHEN ph >= 2 THEN tm ELSE -1 END', 'CASE WHEN ph >= 2 THEN pl END')}]",
    _START,
)
_STOPPED = """st AS (SELECT match_id, stretch, min(ms) AS start_ms, min(frame) AS start_frame, max(ms) AS end_ms, max(frame) AS end_frame, 'neutral' AS state, CAST(NULL AS BIGINT) AS player_id, CAST(NULL AS BIGINT) AS decided_frame FROM py WHERE NOT in_play GROUP BY match_id, stretch)
SELECT *, true AS active FROM sp UNION ALL SELECT *, false FROM st"""


@query(f"{PY}, {SQL_STRICT}, {_STOPPED}")
def rec_possession(spark, folder):
    """Team possession: held from a confirmed first touch to the last touch, neutral between, stoppages inactive."""
    rows = play(spark, folder)
    return P.with_stoppages(P.strict_possessions(rows.where("in_play")), rows.where("NOT in_play"))


@query(f"{PY}, {SQL_LOOSE}, {_STOPPED}")
def rec_loose_possession(spark, folder):
    """The last team to touch has the ball until it is demonstrably taken, from the taker's first touch on."""
    rows = play(spark, folder)
    return P.with_stoppages(P.loose_possessions(rows.where("in_play")), rows.where("NOT in_play"))


SQL_HOLDERS = """h AS (
  SELECT match_id, stretch, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS frame, CAST(NULL AS INTEGER) AS tm, CAST(NULL AS BIGINT) AS pl, CAST(NULL AS BIGINT) AS la, CAST(NULL AS BIGINT) AS pe FROM n WHERE rn = 1
  UNION ALL
  SELECT match_id, stretch, nrn, frame,
    CASE kind WHEN 1 THEN CASE WHEN tm IS NULL OR tm = tt OR pe IS NOT NULL THEN tt ELSE tm END ELSE tm END,
    CASE kind WHEN 1 THEN CASE WHEN tm IS NULL OR pe IS NOT NULL OR tm = tt THEN tp END WHEN 2 THEN NULL ELSE pl END,
    CASE kind WHEN 1 THEN CASE WHEN tm IS NULL OR pe IS NOT NULL OR tm = tt THEN ms ELSE la END WHEN 2 THEN CASE WHEN tm IS NOT NULL THEN ms ELSE la END ELSE la END,
    CASE kind WHEN 1 THEN CASE WHEN tm IS NULL OR pe IS NOT NULL OR tm = tt THEN NULL ELSE ms END WHEN 2 THEN CASE WHEN tm IS NOT NULL THEN ms END ELSE pe END
  FROM (SELECT match_id, stretch, nrn, frame, ms, kind, tt, tp, CASE WHEN gone THEN NULL ELSE tm END AS tm, CASE WHEN gone THEN NULL ELSE pl END AS pl, CASE WHEN gone THEN NULL ELSE la END AS la, CASE WHEN gone THEN NULL ELSE pe END AS pe
    FROM (SELECT f.*, n.ms, n.frame AS nframe, n.rn AS nrn, CASE WHEN n.toucher0 IS NULL AND n.toucher1 IS NULL THEN 0 WHEN n.toucher0 IS NULL OR n.toucher1 IS NULL THEN 1 ELSE 2 END AS kind, CASE WHEN n.toucher0 IS NULL THEN 1 ELSE 0 END AS tt, coalesce(n.toucher0, n.toucher1) AS tp,
      coalesce(n.ms - f.pe >= 1250, n.ms - f.la >= 3000, false) AS gone FROM h f JOIN n ON n.match_id = f.match_id AND n.stretch = f.stretch AND n.rn = f.rn + 1) q0(match_id, stretch, rn, frame0, tm, pl, la, pe, ms, frame, nrn, kind, tt, tp, gone)) q),
ho AS (SELECT match_id, stretch, frame, CAST(tm AS BIGINT) AS holder_team, pl AS holder FROM h WHERE rn > 0)"""


@query(f"{PY}, {SQL_HOLDERS} SELECT * FROM ho")
def rec_holder(spark, folder):
    """Who holds the ball in every frame of play, decided as it happens."""
    return P.holders(play(spark, folder).where("in_play"))


SQL_HELD = f"""sy AS (SELECT match_id, frame, player_id, {', '.join(f'{e} AS p{c}' for c, e in STRAYED.items())} FROM (SELECT match_id, frame, player_id, x, y, z, ball_x AS bx, ball_y AS b2, ball_z AS bz FROM pl)),
w0 AS (SELECT n.match_id, n.stretch, n.frame, n.rn, n.ms, n.dt_ms, n.ball_x, n.ball_y, n.ball_z, n.prev_ball_y, n.third, n.toucher0, n.toucher1, ho.holder_team, ho.holder, px, py, pz,
  sqrt((px - n.ball_x) ** 2 + (py - n.ball_y) ** 2 + (pz - n.ball_z) ** 2) AS gap, pz >= 120 AND (abs(px) >= 3600 OR (abs(py) >= 5000 AND abs(px) > 900)) AS wall,
  n.ball_z BETWEEN 97.75 AND 600 AND sqrt((px - n.ball_x) ** 2 + (py - n.ball_y) ** 2) <= 129.85 AND n.ball_z - pz BETWEEN 0 AND 220 AS lies
  FROM n JOIN ho USING (match_id, stretch, frame) LEFT JOIN sy ON sy.match_id = n.match_id AND sy.frame = n.frame AND sy.player_id = ho.holder),
w1 AS (SELECT *, CASE WHEN coalesce(gap <= 2500, true) THEN holder END AS cur, coalesce(lies AND NOT wall, false) AS carried FROM w0),
w2 AS (SELECT *, coalesce(toucher0 = cur OR toucher1 = cur, false) AS touched FROM w1)"""
# Frame by frame: a: the active possession's number, s: the one that is suspended, since when and whose.
SQL_PLAYER = f"""v AS (
  SELECT match_id, stretch, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS ap, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS sp, CAST(NULL AS BIGINT) AS since, CAST(0 AS BIGINT) AS top, CAST(0 AS BIGINT) AS hold FROM w2 WHERE rn = 1
  UNION ALL
  SELECT v.match_id, v.stretch, w.rn, w.frame,
    CASE WHEN w.cur IS NULL THEN NULL WHEN w.cur = v.ap THEN v.a WHEN v.a IS NULL AND w.cur = v.sp AND w.ms - v.since <= 2000 THEN v.s ELSE v.top + 1 END,
    w.cur,
    CASE WHEN w.cur IS NOT NULL THEN NULL WHEN v.a IS NOT NULL THEN v.a WHEN w.ms - v.since <= 2000 THEN v.s END,
    CASE WHEN w.cur IS NOT NULL THEN NULL WHEN v.a IS NOT NULL THEN v.ap WHEN w.ms - v.since <= 2000 THEN v.sp END,
    CASE WHEN w.cur IS NOT NULL THEN NULL WHEN v.a IS NOT NULL THEN w.ms WHEN w.ms - v.since <= 2000 THEN v.since END,
    CASE WHEN w.cur IS NULL OR w.cur IS NOT DISTINCT FROM v.ap OR (v.a IS NULL AND w.cur IS NOT DISTINCT FROM v.sp AND w.ms - v.since <= 2000) THEN v.top ELSE v.top + 1 END,
    CASE WHEN w.cur IS NOT NULL AND w.cur IS DISTINCT FROM v.ap THEN v.hold + 1 ELSE v.hold END
  FROM v JOIN w2 w ON w.match_id = v.match_id AND w.stretch = v.stretch AND w.rn = v.rn + 1),
u0 AS (SELECT w2.*, a AS possession, hold, max(CASE WHEN touched THEN w2.frame END) OVER (PARTITION BY w2.match_id, w2.stretch, hold) AS last_touch, lag(carried, 1, false) OVER (PARTITION BY w2.match_id, w2.stretch, hold ORDER BY w2.frame) AS was_carried,
  (ball_y - prev_ball_y) * CASE WHEN holder_team = 0 THEN 1 ELSE -1 END AS fwd FROM w2 JOIN v ON v.match_id = w2.match_id AND v.stretch = w2.stretch AND v.frame = w2.frame WHERE a IS NOT NULL),
u AS (SELECT *, coalesce(frame <= last_touch, false) AS counts FROM u0),
t0 AS (SELECT *, row_number() OVER (PARTITION BY match_id, stretch, possession ORDER BY frame) AS tn FROM u WHERE touched),
tr AS (SELECT match_id, stretch, possession, tn, ms AS kept, true AS keep, wall, pz FROM t0 WHERE tn = 1
  UNION ALL SELECT t.match_id, t.stretch, t.possession, t.tn, CASE WHEN t.ms - tr.kept >= 120 THEN t.ms ELSE tr.kept END, t.ms - tr.kept >= 120, t.wall, t.pz FROM tr JOIN t0 t ON t.match_id = tr.match_id AND t.stretch = tr.stretch AND t.possession = tr.possession AND t.tn = tr.tn + 1),
tk AS (SELECT match_id, stretch, possession, count(*) AS touch_count, CAST(sum(coalesce(wall, false)::INT) AS BIGINT) AS wall_touch_count, CAST(sum((NOT coalesce(wall, false) AND coalesce(pz > 20, false))::INT) AS BIGINT) AS aerial_touch_count, max(kept) - min(kept) AS touch_span FROM tr WHERE keep GROUP BY 1, 2, 3),
po AS (SELECT match_id, stretch, possession, any_value(cur) AS player_id, any_value(holder_team) AS team, greatest(min(frame) - 1, 0) AS start_frame, max(frame) AS end_frame, greatest(arg_min(ms - dt_ms, frame), 0) AS start_ms, max(ms) AS end_ms,
  CAST(coalesce(sum(dt_ms) FILTER (counts), 0) AS BIGINT) AS duration_ms, CAST(coalesce(sum(dt_ms) FILTER (counts AND gap <= 700), 0) AS BIGINT) AS close_ms, CAST(coalesce(sum(dt_ms) FILTER (counts AND carried), 0) AS BIGINT) AS carry_ms,
  CAST(sum((carried AND NOT was_carried)::INT) AS BIGINT) AS carry_count, round(coalesce(sum(greatest(fwd, 0)) FILTER (counts), 0), 3) AS advance_distance, round(coalesce(sum(greatest(-fwd, 0)) FILTER (counts), 0), 3) AS retreat_distance,
  arg_min(third, frame) AS start_third, arg_max(third, frame) AS end_third, count(DISTINCT hold) AS n_parts FROM u GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {SQL_PLAYERS}, {SQL_PLAY}, n AS (SELECT * FROM py WHERE in_play), {SQL_HOLDERS}, {SQL_HELD}, {SQL_PLAYER}
SELECT match_id, stretch, player_id, team, start_frame, end_frame, start_ms, end_ms, duration_ms, close_ms, carry_ms, carry_count, advance_distance, retreat_distance, start_third, end_third, n_parts, touch_count, wall_touch_count, aerial_touch_count,
  duration_ms >= 1000 AND touch_span >= 1000 AND close_ms >= 750 AS sustained_control FROM po JOIN tk USING (match_id, stretch, possession) WHERE touch_count >= 2""")
def rec_player_possession(spark, folder):
    """Possessions of players over short interruptions, what follows the last touch of each part taken back."""
    frames = recordings.frames(spark, folder)
    rows = recordings.play(frames).where("in_play")
    held = rows.join(P.holders(rows), [*P.KEYS, "frame"])
    found = P.player_possessions(P.within_reach(held, recordings.strayed(recordings.players(frames), frames)))
    return found.drop("possession").withColumns({c: F.round(c, 3) for c in ("advance_distance", "retreat_distance")})


# --- dodge resets


#: The ball's height in the car's own frame: the car is turned by a unit quaternion about (0.6, 0, 0.8).
QX, QZ, QW = "0.6 * up", "0.8 * up", "sqrt(1 - up * up)"
AWAY = ("(bx - x)", "(b2 - y)", "(bz - z)")
_U = (f"-({QX})", "0.0", f"-({QZ})")
_TX, _TY, _TZ = (f"2 * ({_U[1]} * {AWAY[2]} - {_U[2]} * {AWAY[1]})", f"2 * ({_U[2]} * {AWAY[0]} - {_U[0]} * {AWAY[2]})", f"2 * ({_U[0]} * {AWAY[1]} - {_U[1]} * {AWAY[0]})")
LOCAL_Z = f"{AWAY[2]} + {QW} * ({_TZ}) + {_U[0]} * ({_TY}) - {_U[1]} * ({_TX})"
_NEAR = f"sqrt({' + '.join(f'{a} * {a}' for a in AWAY)})"
# Frame by frame. p: a pending reset's ms and frame; onset: its dodge's; l: its latest touch; d: last frame of a dodge; e: what ended in this frame.
_T_OK = "(NOT (({onset}) - p_ms < 50 AND ({touch}) - p_ms < 50) OR ({contact}))"
_CARRIED = "coalesce(ms - onset BETWEEN 0 AND 350 OR (d_ms >= onset AND ms - d_ms <= 250), false)"
_DONE = "{{'reset': p_fr, 'outcome': {what}, 'ms': {ms}, 'frame': {frame}, 'use': {use}}}"


def _drop(when: str, done: str) -> str:
    """One step of a frame: if ``when``, the pending reset ends as ``done``."""
    return f"""CASE WHEN {when} THEN list_append(em, {done}) ELSE em END AS em, CASE WHEN {when} THEN NULL ELSE p_ms END AS p_ms, CASE WHEN {when} THEN NULL ELSE p_fr END AS p_fr,
  CASE WHEN {when} THEN NULL ELSE onset END AS onset, CASE WHEN {when} THEN NULL ELSE l_ms END AS l_ms, CASE WHEN {when} THEN NULL ELSE l_fr END AS l_fr, CASE WHEN {when} THEN NULL ELSE l_c END AS l_c"""


def _done(what: str, ms: str, frame: str, use: str) -> str:
    return _DONE.format(what=f"CAST({what} AS VARCHAR)", ms=f"CAST({ms} AS BIGINT)", frame=f"CAST({frame} AS BIGINT)", use=f"CAST({use} AS BIGINT)")


def _confirmed(onset: str, ms: str, frame: str) -> str:
    return _done(f"CASE WHEN {onset} - p_ms > 2000 THEN 'expired' ELSE 'used' END", ms, frame, f"CASE WHEN {onset} - p_ms <= 2000 THEN {ms} - p_ms END")


_ROW = "match_id, player_id, rn, frame, ms, dodging, edge, touched, contact, armed, goal, stopped, z, n_last, d_ms, d_was"
_EDGE_WHEN = f"edge AND p_ms IS NOT NULL AND l_ms IS NOT NULL AND ms - l_ms <= 250 AND {_T_OK.format(onset='ms', touch='l_ms', contact='l_c')}"
_SAME_WHEN = f"armed AND p_ms IS NOT NULL AND touched AND (contact OR dodging OR {_CARRIED}) AND {_T_OK.format(onset='coalesce(onset, ms)', touch='ms', contact='contact')}"
_TOUCH_WHEN = f"touched AND NOT eaten AND p_ms IS NOT NULL AND onset IS NOT NULL AND (contact OR {_CARRIED}) AND {_T_OK.format(onset='onset', touch='ms', contact='contact')}"
_ONCE_WHEN = "touched AND NOT eaten AND p_ms IS NOT NULL AND contact AND dodging AND p_fr = frame"
SQL_RESETS = f"""on_ AS (SELECT *, z >= 95 AND bz >= 80 AND {_NEAR} <= 180 AND {LOCAL_Z} <= 140 AS on_ball, row_number() OVER (PARTITION BY match_id, player_id ORDER BY frame) AS rn, dodging AND NOT lag(dodging, 1, false) OVER (PARTITION BY match_id, player_id ORDER BY frame) AS edge,
  NOT in_play AND lag(in_play, 1, true) OVER (PARTITION BY match_id, player_id ORDER BY frame) AS stopped, max(frame) OVER (PARTITION BY match_id) AS n_last FROM dz),
on1 AS (SELECT *, touched AND (touch_contact OR dodging) AS contact, refreshed AND on_ball AS armed FROM on_),
rz AS (
  SELECT match_id, player_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS d_ms, CAST(NULL AS BIGINT) AS p_ms, CAST(NULL AS BIGINT) AS p_fr, CAST(NULL AS BIGINT) AS onset, CAST(NULL AS BIGINT) AS l_ms, CAST(NULL AS BIGINT) AS l_fr, CAST(NULL AS BOOLEAN) AS l_c,
    list_filter([{_done("''", '0', '0', '0').replace('p_fr', 'CAST(0 AS BIGINT)')}], lambda x: false) AS em FROM on1 WHERE rn = 1
  UNION ALL
  SELECT match_id, player_id, rn, d_ms, p_ms, p_fr, onset, l_ms, l_fr, l_c, CASE WHEN p_ms IS NOT NULL AND frame = n_last THEN list_append(em, {_done("'recording_ended'", 'ms', 'frame', 'NULL')}) ELSE em END FROM (
  SELECT {_ROW}, {_drop('z <= 80 AND p_ms IS NOT NULL', _done("'landed'", 'ms', 'frame', 'NULL'))} FROM (
  SELECT {_ROW}, {_drop(_ONCE_WHEN, _confirmed('ms', 'ms', 'frame'))} FROM (
  SELECT {_ROW}, eaten, {_drop(_TOUCH_WHEN, _confirmed('onset', 'ms', 'frame'))} FROM (
  SELECT {_ROW}, eaten, em, p_ms, p_fr, onset, CASE WHEN touched AND NOT eaten AND p_ms IS NOT NULL THEN ms ELSE l_ms END AS l_ms, CASE WHEN touched AND NOT eaten AND p_ms IS NOT NULL THEN frame ELSE l_fr END AS l_fr, CASE WHEN touched AND NOT eaten AND p_ms IS NOT NULL THEN contact ELSE l_c END AS l_c FROM (
  SELECT {_ROW}, eaten, CASE WHEN armed AND p_ms IS NOT NULL THEN list_append(em, {_done("'superseded'", 'ms', 'frame', 'NULL')}) ELSE em END AS em, CASE WHEN armed THEN ms ELSE p_ms END AS p_ms, CASE WHEN armed THEN frame ELSE p_fr END AS p_fr,
    CASE WHEN armed THEN NULL ELSE onset END AS onset, CASE WHEN armed THEN NULL ELSE l_ms END AS l_ms, CASE WHEN armed THEN NULL ELSE l_fr END AS l_fr, CASE WHEN armed THEN NULL ELSE l_c END AS l_c FROM (
  SELECT {_ROW}, coalesce({_SAME_WHEN}, false) AS eaten, {_drop(f'coalesce({_SAME_WHEN}, false)', _confirmed('coalesce(onset, ms)', 'ms', 'frame'))} FROM (
  SELECT {_ROW}, {_drop(_EDGE_WHEN, _confirmed('ms', 'l_ms', 'l_fr'))} FROM (
  SELECT {_ROW}, em, p_ms, p_fr, CASE WHEN edge AND p_ms IS NOT NULL THEN ms ELSE onset END AS onset, l_ms, l_fr, l_c FROM (
  SELECT {_ROW}, {_drop('stopped AND p_ms IS NOT NULL', _done("'play_ended'", 'ms', 'frame', 'NULL'))} FROM (
  SELECT {_ROW}, {_drop('goal AND p_ms IS NOT NULL', _done("'goal_scored'", 'ms', 'frame', 'NULL'))} FROM (
  SELECT n.match_id, n.player_id, n.rn, n.frame, n.ms, n.dodging, n.edge, n.touched, n.contact, n.armed, n.goal, n.stopped, n.z, n.n_last, CASE WHEN n.dodging THEN n.ms ELSE r.d_ms END AS d_ms, r.d_ms AS d_was, r.p_ms, r.p_fr, r.onset, r.l_ms, r.l_fr, r.l_c,
    list_filter(r.em, lambda x: false) AS em FROM rz r JOIN on1 n ON n.match_id = r.match_id AND n.player_id = r.player_id AND n.rn = r.rn + 1)))))))))))),
oc AS (SELECT match_id, player_id, unnest(em) AS e FROM rz),
rs AS (SELECT o.match_id, o.player_id, o.team, o.frame, o.ms, o.on_ball, e.outcome, e.frame AS outcome_frame, e.ms AS outcome_ms, e.use AS time_to_use, coalesce(e.outcome = 'used', false) AS used
  FROM on1 o LEFT JOIN oc ON oc.match_id = o.match_id AND oc.player_id = o.player_id AND e.reset = o.frame AND o.armed WHERE refreshed)"""
RZ = f"WITH RECURSIVE {SQL_PLAYERS}, {SQL_PLAY}, {SQL_RESET}, {SQL_RESETS}"


def dodge_rows(spark, folder):
    rec = recordings.Recording.of(spark, folder)
    rows = recordings.dodge_frames(rec.frames, rec.players)
    up = F.col("up")
    q = (up * 0.6, F.lit(0.0), up * 0.8, F.sqrt(1 - up * up))
    return rows.withColumn("on_ball", R.on_ball(tuple(map(F.col, ("x", "y", "z"))), q, tuple(map(F.col, ("bx", "b2", "bz")))))


@query(f"{RZ} SELECT * FROM rs")
def rec_dodge_reset(spark, folder):
    """Dodges granted anew, those on the ball with the outcome that is known only later."""
    return R.dodge_resets(dodge_rows(spark, folder))


@query(f"{RZ} SELECT match_id, player_id, team, frame AS reset_frame, outcome_frame AS frame, time_to_use FROM rs WHERE used")
def rec_flip_reset(spark, folder):
    """Resets on the ball that a dodge into the ball used."""
    found = R.dodge_resets(dodge_rows(spark, folder)).where("used")
    return found.select("match_id", "player_id", "team", F.col("frame").alias("reset_frame"), F.col("outcome_frame").alias("frame"), "time_to_use")


@query(f"""{RZ}, tx AS (SELECT match_id, player_id, frame, ms FROM dz WHERE touched)
SELECT tx.match_id, tx.player_id, tx.frame, EXISTS (SELECT 1 FROM rs WHERE rs.match_id = tx.match_id AND rs.player_id = tx.player_id AND tx.ms - rs.ms BETWEEN 0 AND 1500) AS reset,
  EXISTS (SELECT 1 FROM rs WHERE rs.match_id = tx.match_id AND rs.player_id = tx.player_id AND rs.on_ball AND tx.ms - rs.ms BETWEEN 0 AND 1500) AS reset_committed FROM tx""")
def rec_recent_reset(spark, folder):
    """Touches with whether the player had a reset in the 1.5 s before: any, and on the ball."""
    rows = dodge_rows(spark, folder)
    events = rows.where("refreshed").select("match_id", "player_id", "ms", F.col("on_ball").alias("committed"))
    return R.recently(rows.where("touched").select("match_id", "player_id", "frame", "ms"), events, 1500, "reset").drop("ms")


# --- half flips

# Candidates with all their frames, each value an aggregate over the frames up to the evaluation.
SQL_HALF_FLIPS = f"""hx0 AS (SELECT *, cos(pitch) * cos(yaw) AS fx, cos(pitch) * sin(yaw) AS fy, -sin(pitch) AS fz, max(frame) OVER (PARTITION BY match_id) AS last_frame FROM hf),
hx1 AS (SELECT *, sum(CASE WHEN in_play IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id ORDER BY frame) AS stretch FROM (SELECT *, lag(in_play) OVER (PARTITION BY match_id, player_id ORDER BY frame) AS was FROM hx0)),
hx2 AS (SELECT *, sqrt(fx * fx + fy * fy) AS flat, sqrt(vx * vx + vy * vy) AS sp, lag(dodging, 1, false) OVER w AS dodged, last_value(CASE WHEN NOT dodging THEN spin END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cspin,
  last_value(CASE WHEN NOT dodging THEN abs(fz) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cvert FROM hx1 WHERE in_play WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame)),
hs AS (SELECT match_id, player_id, team, stretch, frame AS s_fr, ms AS s_ms, fx / flat AS sx, fy / flat AS sy, CASE WHEN sp > 0 THEN vx / sp ELSE 0 END AS sux, CASE WHEN sp > 0 THEN vy / sp ELSE 0 END AS suy, cspin, cvert,
  lead(frame) OVER (PARTITION BY match_id, player_id ORDER BY frame) AS next_fr FROM hx2 WHERE dodging AND NOT dodged AND flat > 0.001),
hj AS (SELECT s.*, r.frame, r.ms, r.flat, r.fz, r.last_frame, CASE WHEN r.flat >= 0.55 THEN greatest(-1, least(1, -(sx * r.fx + sy * r.fy) / r.flat)) END AS rev, CASE WHEN r.flat >= 0.55 AND r.sp > 0.001 THEN (r.fx * r.vx + r.fy * r.vy) / (r.flat * r.sp) END AS reo
  FROM hs s JOIN hx2 r ON r.match_id = s.match_id AND r.player_id = s.player_id AND r.stretch = s.stretch AND r.frame >= s_fr AND (next_fr IS NULL OR r.frame < next_fr)),
hv1 AS (SELECT match_id, player_id, s_fr, coalesce(min(frame) FILTER (ms - s_ms >= 650), max(frame) FILTER (frame = last_frame)) AS v_fr FROM hj GROUP BY 1, 2, 3),
hk AS (SELECT hj.*, v_fr FROM hj JOIN hv1 USING (match_id, player_id, s_fr) WHERE frame <= v_fr),
hr AS (SELECT match_id, player_id, s_fr, min(frame) FILTER (rev >= 0.75) AS reached FROM hk GROUP BY 1, 2, 3),
hm AS (SELECT k.match_id, k.player_id, any_value(team) AS team, s_fr, any_value(v_fr) AS v_fr, greatest(0, coalesce(max(rev), 0)) AS best, coalesce(arg_max(rev, frame) FILTER (rev IS NOT NULL), 0) AS latest, coalesce(min(rev) FILTER (frame >= reached), 1) AS retained, arg_max(flat, frame) AS flat, max(abs(fz)) AS vertical,
  greatest(0, coalesce(max(reo), 0)) AS reo, any_value(-(sx * sux + sy * suy)) AS entry, coalesce(any_value(cspin) >= 250 OR any_value(cvert) >= 0.5, false) AS tumbling FROM hk k JOIN hr USING (match_id, player_id, s_fr) GROUP BY k.match_id, k.player_id, s_fr),
hc AS (SELECT *, greatest(0, least(1, (latest - 0.75) / 0.23)) * 0.75 + greatest(0, least(1, (vertical - 0.55) / 0.3)) * 0.25 AS confidence FROM hm)"""


@query(f"""WITH {SQL_PLAYERS}, {SQL_PLAY}, {SQL_FLIP}, {SQL_HALF_FLIPS}
SELECT match_id, player_id, team, s_fr AS start_frame, v_fr AS frame, round(best, 6) AS reversal, round(vertical, 6) AS vertical, round(entry, 6) AS backward_entry, round(reo, 6) AS reorientation, round(confidence, 6) AS confidence
FROM hc WHERE latest >= 0.75 AND retained >= 0.45 AND flat >= 0.55 AND vertical >= 0.55 AND confidence >= 0.55 AND NOT (tumbling AND entry < 0)""")
def rec_half_flip(spark, folder):
    """Dodges that turn the nose around, judged 0.65 s after they begin; the nose comes from quaternions of yaw and pitch."""
    rec = recordings.Recording.of(spark, folder)
    rows = recordings.flip_frames(rec.frames, rec.players)
    zero, one = F.lit(0.0), F.lit(1.0)
    q = C.product(C.axis_angle((zero, zero, one), F.col("yaw")), C.axis_angle((zero, one, zero), F.col("pitch")))
    rows = rows.withColumns(dict(zip(("fx", "fy", "fz"), H.nose(q))))
    return H.half_flips(rows).withColumns({c: F.round(c, 6) for c in ("reversal", "vertical", "backward_entry", "reorientation", "confidence")})
