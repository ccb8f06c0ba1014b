"""Queries of the detectors on recordings (sources/recordings.py), each with the SQL that DuckDB can check it with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import derive as V
from kairoframe.operators import detectors as D
from kairoframe.operators import folds, matching, pickups, scans, temporal
from kairoframe.operators import mechanics as M
from kairoframe.plans.registry import query
from kairoframe.sources import clips, recordings, sinks
from kairoframe.sources.recordings import SQL_FRAMES, SQL_GOALS, SQL_PICKUPS, SQL_PLAYERS, SQL_TOUCHES

FR, PL = f"WITH {SQL_FRAMES}", f"WITH {SQL_PLAYERS}"
TO, PT = f"{FR}, {SQL_TOUCHES}", f"{PL}, {SQL_TOUCHES}"
MW, PW, TW = "PARTITION BY match_id ORDER BY frame", "PARTITION BY match_id, player_id ORDER BY frame", "PARTITION BY match_id ORDER BY t, frame"


def ny(y="y", team="team"):
    return f"(CASE WHEN {team} = 0 THEN {y} ELSE -({y}) END)"


def frames(spark, folder):
    return recordings.frames(spark, folder)


def players(spark, folder):
    return recordings.players(frames(spark, folder))


def touches(spark, folder):
    return recordings.touches(frames(spark, folder))


def goals(spark, folder):
    return recordings.goals(frames(spark, folder))


def demos(spark, folder):
    return demolished(frames(spark, folder))


DEMOLISHED, VICTIM = "event_type = 'error' AND k % 2 = 1", "match_id * 4 + (user_id + 1) % 4"


def demolished(frames):
    """Demolitions: a user's error with an odd k brings down the next user of the match."""
    return frames.where(DEMOLISHED).select("match_id", "frame", "t", F.col("user_id").alias("attacker"), F.expr(VICTIM).alias("victim"))


SQL_DEMOS = "de AS (SELECT match_id, frame, t, user_id AS attacker, match_id * 4 + (user_id + 1) % 4 AS victim FROM fr WHERE event_type = 'error' AND k % 2 = 1)"


def spans_sql(rel: str, keys: str, state: str, clock: str = "t") -> str:
    """CTEs up to ``sp``: runs of equal states of a relation ordered by frame."""
    w = f"PARTITION BY {keys} ORDER BY frame"
    return f"""s0 AS (SELECT *, {state} AS st FROM {rel}),
s1 AS (SELECT *, lag(st) OVER ({w}) AS pst, row_number() OVER ({w}) AS rn, lead({clock}) OVER ({w}) AS nx FROM s0),
s2 AS (SELECT *, sum(CASE WHEN rn = 1 OR st IS DISTINCT FROM pst THEN 1 ELSE 0 END) OVER ({w}) AS island FROM s1),
sp AS (SELECT {keys}, CAST(island AS BIGINT) AS island, any_value(st) AS state, min({clock}) AS "start", max(coalesce(nx, {clock})) AS "end", count(*) AS n_samples FROM s2 GROUP BY {keys}, island)"""


SQL_HALF = "CASE WHEN live THEN CASE WHEN ball_y < -200 THEN 'team0_half' WHEN ball_y < 200 THEN 'neutral' ELSE 'team1_half' END END"
SQL_THIRD = "CASE WHEN live THEN CASE WHEN ball_y < -2300 THEN 'team0_third' WHEN ball_y < 2300 THEN 'middle' ELSE 'team1_third' END END"
SQL_SPEED = "CASE WHEN speed < 1410 THEN 'slow' WHEN speed < 2200 THEN 'boost' ELSE 'supersonic' END"
SQL_HEIGHT = "CASE WHEN z <= 20 THEN 'ground' WHEN z >= 735.525 THEN 'high_air' ELSE 'low_air' END"
SQL_PASSES = f"""pa0 AS (SELECT *, lag(t) OVER ({TW}) AS prev_t, lag(player_id) OVER ({TW}) AS pp, lag(team) OVER ({TW}) AS pteam,
  sqrt((x - lag(x) OVER ({TW})) * (x - lag(x) OVER ({TW})) + (y - lag(y) OVER ({TW})) * (y - lag(y) OVER ({TW})) + (z - lag(z) OVER ({TW})) * (z - lag(z) OVER ({TW}))) AS travel FROM tc),
pa AS (SELECT match_id, frame, t, team, pp AS passer, player_id AS receiver, travel, prev_t FROM pa0 WHERE team = pteam AND player_id <> pp AND t - prev_t BETWEEN 0 AND 3.5 AND travel >= 500)"""
SQL_BOUNCES = f"""bo0 AS (SELECT *, lag(ball_vy) OVER ({MW}) AS pvy, last_value(CASE WHEN event_type IN ('click', 'view') THEN user_id END IGNORE NULLS) OVER ({MW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_id,
  last_value(CASE WHEN event_type IN ('click', 'view') THEN t END IGNORE NULLS) OVER ({MW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_t FROM fr),
bo AS (SELECT match_id, frame, t, by_id AS player_id, CAST(by_id % 2 AS INT) AS team FROM bo0
  WHERE live AND ball_z >= 500 AND {ny('ball_y', 'by_id % 2')} >= 4700 AND {ny('pvy', 'by_id % 2')} >= 350 AND {ny('ball_vy', 'by_id % 2')} <= -250 AND t - by_t <= 2.5)"""
GT = "((CASE WHEN team = 0 THEN 5120.0 ELSE -5120.0 END) - ball_y) / nullif(ball_vy, 0)"
SQL_ON_NET = f"(ball_vy <> 0 AND {GT} >= 0 AND abs(ball_x + ball_vx * {GT}) <= 892.755 AND ball_z + ball_vz * {GT} BETWEEN 0 AND 642.775)"
BALL_SPEED = "sqrt(ball_vx * ball_vx + ball_vy * ball_vy + ball_vz * ball_vz)"
SQL_ONE_TIMERS = f"""ot AS (SELECT pa.match_id, pa.frame, pa.t, pa.team, passer, receiver FROM pa JOIN (SELECT match_id, frame, ball_x, ball_y, ball_z, ball_vx, ball_vy, ball_vz FROM fr) USING (match_id, frame)
  WHERE {BALL_SPEED} >= 1000 AND {SQL_ON_NET} AND (ball_vx * -ball_x + ball_vy * ((CASE WHEN team = 0 THEN 5120.0 ELSE -5120.0 END) - ball_y) + ball_vz * (321.3875 - ball_z))
    / nullif({BALL_SPEED} * sqrt(ball_x * ball_x + ((CASE WHEN team = 0 THEN 5120.0 ELSE -5120.0 END) - ball_y) ** 2 + (321.3875 - ball_z) ** 2), 0) >= 0.65)"""
SQL_DODGES = f"""dg0 AS (SELECT *, lag(dodging, 1, false) OVER ({PW}) AS was FROM pl), dg1 AS (SELECT match_id, player_id, team, frame, t, vx AS bx, vy AS by_, vz AS bz FROM dg0 WHERE dodging AND NOT was),
dg2 AS (SELECT d.*, p.vx - bx AS dx, p.vy - by_ AS dy, p.vz - bz AS dz, p.t AS at_t, sqrt((p.vx - bx) ** 2 + (p.vy - by_) ** 2 + (p.vz - bz) ** 2) AS delta FROM dg1 d JOIN pl p ON p.match_id = d.match_id AND p.player_id = d.player_id AND p.t - d.t BETWEEN 0 AND 0.18),
dg3 AS (SELECT * FROM dg2 QUALIFY row_number() OVER (PARTITION BY match_id, player_id, frame ORDER BY delta DESC, at_t) = 1),
dg4 AS (SELECT *, CASE WHEN bx = 0 AND by_ = 0 THEN 1.0 ELSE bx / sqrt(bx * bx + by_ * by_) END AS hx, CASE WHEN bx = 0 AND by_ = 0 THEN 0.0 ELSE by_ / sqrt(bx * bx + by_ * by_) END AS hy FROM dg3 WHERE delta >= 10),
dg AS (SELECT match_id, player_id, team, frame, t, delta, CASE WHEN abs((dx * hx + dy * hy) / delta) >= 0.45 THEN CASE WHEN dx * hx + dy * hy > 0 THEN 'forward' ELSE 'backward' END
  WHEN abs((dy * hx - dx * hy) / delta) >= 0.28 THEN CASE WHEN dy * hx - dx * hy > 0 THEN 'left' ELSE 'right' END WHEN abs(dz / delta) >= 0.45 THEN CASE WHEN dz > 0 THEN 'up' ELSE 'down' END ELSE 'neutral' END AS direction FROM dg4)"""
SQL_DOUBLE_TAPS = f"""dt0 AS (SELECT tc.*, lag(t) OVER ({TW}) AS before FROM tc),
dt1 AS (SELECT a.*, b.t AS bounce_t, b.player_id AS by_id FROM dt0 a ASOF JOIN (SELECT match_id, t, player_id, frame FROM bo) b ON a.match_id = b.match_id AND a.frame > b.frame),
dt2 AS (SELECT match_id, frame, t, player_id, team, bounce_t FROM dt1 WHERE by_id = player_id AND coalesce(before, -1) < bounce_t),
dbl AS (SELECT dt2.* FROM dt2 JOIN (SELECT match_id, frame, ball_x, ball_y, ball_z, ball_vx, ball_vy, ball_vz FROM fr) USING (match_id, frame) WHERE {SQL_ON_NET})"""
SQL_VOLLEYS = f"""hv0 AS (SELECT *, lag(ball_vz) OVER ({MW}) AS falling FROM fr), hv1 AS (SELECT match_id, frame, t FROM hv0 WHERE ball_z <= 138 AND falling <= -250 AND ball_vz >= 150),
hv2 AS (SELECT a.*, b.t AS bounced FROM tc a ASOF JOIN hv1 b ON a.match_id = b.match_id AND a.frame > b.frame),
hv3 AS (SELECT a.*, b.t AS dodged FROM hv2 a ASOF JOIN (SELECT match_id, player_id, frame, t FROM dg) b ON a.match_id = b.match_id AND a.player_id = b.player_id AND a.frame > b.frame WHERE a.t - bounced <= 0.45),
hv AS (SELECT match_id, frame, t, player_id, team, bounced, dodged FROM hv3 JOIN (SELECT match_id, frame FROM fr WHERE {BALL_SPEED} >= 1000) USING (match_id, frame) WHERE t - dodged <= 0.35)"""
SQL_FIFTY = f"""ff0 AS (SELECT *, lag(t) OVER ({TW}) AS pt, lag(player_id) OVER ({TW}) AS pp, lag(team) OVER ({TW}) AS pteam FROM tc),
ff1 AS (SELECT match_id, frame, t, CASE WHEN team = 0 THEN player_id ELSE pp END AS p0, CASE WHEN team = 1 THEN player_id ELSE pp END AS p1 FROM ff0 WHERE team <> pteam AND t - pt <= 0.2),
ff2 AS (SELECT f.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM ff1 f JOIN pl a ON a.match_id = f.match_id AND a.frame = f.frame AND a.player_id = p0 JOIN pl b ON b.match_id = f.match_id AND b.frame = f.frame AND b.player_id = p1),
ff3 AS (SELECT f.*, r.frame AS resolved_frame, ball_x, ball_y, ball_vx, ball_vy, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM ff2 f JOIN fr r ON r.match_id = f.match_id AND r.t - f.t BETWEEN 0.35 AND 1.25 QUALIFY row_number() OVER (PARTITION BY f.match_id, f.frame ORDER BY r.frame) = 1),
ff4 AS (SELECT *, CASE WHEN n > 0 THEN (x1 - x0) / n ELSE 0 END AS nx, CASE WHEN n > 0 THEN (y1 - y0) / n ELSE 1 END AS nn FROM ff3),
ff5 AS (SELECT *, (ball_x - (x0 + x1) / 2) * nx + (ball_y - (y0 + y1) / 2) * nn AS s, ball_vx * nx + ball_vy * nn AS v FROM ff4),
ff AS (SELECT match_id, frame, t, p0, p1, resolved_frame, CASE WHEN abs(s) >= 180 THEN CASE WHEN s > 0 THEN 0 ELSE 1 END WHEN abs(v) >= 220 THEN CASE WHEN v > 0 THEN 0 ELSE 1 END END AS winner FROM ff5)"""
SQL_STARTS = f"ks AS (SELECT match_id, frame, t FROM (SELECT *, lag(kickoff, 1, false) OVER ({MW}) AS was FROM fr) WHERE kickoff AND NOT was)"



def bounces(rec):
    return D.backboard_bounces(rec.frames, rec.touches)


def dodges(rec):
    return M.dodges(rec.players)


def _by(events, player):
    return events.select("match_id", "frame", F.col(player).alias("player_id"))


#: Detectors that consume a recording (recordings.Recording): match_id, frame, player_id of each event.
STREAMS = {
    "touch": lambda rec: _by(rec.touches, "player_id"),
    "pass": lambda rec: _by(D.passes(rec.touches), "receiver"),
    "one_timer": lambda rec: _by(D.one_timers(rec.touches, rec.frames), "receiver"),
    "double_tap": lambda rec: _by(M.double_taps(bounces(rec), rec.touches, rec.frames), "player_id"),
    "dodge": lambda rec: _by(rec.stream("dodges", dodges), "player_id"),
    "half_volley": lambda rec: _by(M.half_volleys(rec.touches, rec.frames, rec.stream("dodges", dodges)), "player_id"),
    "demolition": lambda rec: _by(demolished(rec.frames), "attacker"),
    "backboard": lambda rec: _by(bounces(rec), "player_id"),
}

# --- phases and spans


@query(f"""{FR}, m AS (SELECT *, last_value(CASE WHEN goal THEN 1 WHEN kickoff THEN 0 END IGNORE NULLS) OVER ({MW}) AS mark FROM fr)
SELECT match_id, frame, CASE WHEN kickoff THEN 'kickoff_countdown' WHEN mark = 1 THEN 'post_goal' WHEN hit IS NULL THEN 'unknown' WHEN NOT hit THEN 'kickoff_waiting' ELSE 'active' END AS phase FROM m""")
def rec_live_play(spark, folder):
    return D.live_play(frames(spark, folder)).select("match_id", "frame", "phase")


@query(f"{FR}, {spans_sql('fr', 'match_id', SQL_HALF)} SELECT * FROM sp")
def rec_ball_half(spark, folder):
    return D.ball_half(frames(spark, folder))


@query(f"{FR}, {spans_sql('fr', 'match_id', SQL_THIRD)} SELECT * FROM sp")
def rec_ball_third(spark, folder):
    return D.ball_third(frames(spark, folder))


@query(f"""{PL}, v AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed, CASE WHEN live THEN coalesce(sqrt((x - lag(x) OVER ({PW})) ** 2 + (y - lag(y) OVER ({PW})) ** 2 + (z - lag(z) OVER ({PW})) ** 2), 0) ELSE 0 END AS step FROM pl),
{spans_sql('v', 'match_id, player_id', f"CASE WHEN live THEN {SQL_SPEED} || '/' || {SQL_HEIGHT} END")}
SELECT match_id, player_id, CAST(island AS BIGINT) AS island, any_value(st) AS state, min(frame) AS start_frame, max(frame) AS end_frame, round(sum(dt), 3) AS duration, round(sum(step), 3) AS distance,
  round(CASE WHEN sum(dt) = 0 THEN 0 ELSE sum(speed * dt) / sum(dt) END, 3) AS mean_speed FROM s2 GROUP BY match_id, player_id, island HAVING any_value(st) IS NOT NULL""")
def rec_movement(spark, folder):
    rows = D.movement(players(spark, folder))
    return rows.withColumns({c: F.round(c, 3) for c in ("duration", "distance", "mean_speed")})


@query(f"""{PL}, {spans_sql('pl', 'match_id, player_id', 'powerslide AND z <= 40')} SELECT match_id, player_id, island, "start", "end", n_samples FROM sp WHERE state""")
def rec_powerslide(spark, folder):
    return D.powerslides(players(spark, folder))


def crossing_sql(rel: str, value: str, thresholds: list[int], names: list[str], extra: str = "") -> str:
    """Seconds per player in the regions between thresholds, steps split where they cross."""
    regions = lambda v: " + ".join(f"(CASE WHEN {v} >= {t} THEN 1 ELSE 0 END)" for t in thresholds)
    edges = f"[{', '.join(f'CAST({t} AS DOUBLE)' for t in thresholds)}]"
    n = len(thresholds)
    return f"""c0 AS (SELECT match_id, player_id, frame, dt, {value} AS b, lag({value}) OVER ({PW}) AS a FROM {rel} WHERE live{extra}),
c1 AS (SELECT *, unnest(generate_series(least({regions('a')}, {regions('b')}), greatest({regions('a')}, {regions('b')}))) AS region, least(a, b) AS lo, greatest(a, b) AS hi FROM c0 WHERE a IS NOT NULL),
c2 AS (SELECT *, CASE WHEN lo = hi THEN 1.0 ELSE ((CASE WHEN region = {n} THEN hi ELSE least(hi, {edges}[CAST(region AS INT) + 1]) END) - (CASE WHEN region = 0 THEN lo ELSE greatest(lo, {edges}[CAST(region AS INT)]) END)) / (hi - lo) END AS share FROM c1)
SELECT match_id, player_id, [{', '.join(repr(x) for x in names)}][CAST(region AS INT) + 1] AS {{label}}, round(sum(dt * share), 6) AS seconds FROM c2 GROUP BY 1, 2, 3"""


@query(f"{PL}, " + crossing_sql("pl", ny(), [-2300, 2300], ["defensive", "neutral", "offensive"]).format(label="third"))
def rec_field_third(spark, folder):
    return D.field_thirds(players(spark, folder)).withColumn("seconds", F.round("seconds", 6))


@query(f"{PL}, " + crossing_sql("pl", ny(), [0], ["defensive", "offensive"]).format(label="half"))
def rec_field_half(spark, folder):
    return D.field_regions(players(spark, folder), "half").withColumn("seconds", F.round("seconds", 6))


@query(f"{PL}, " + crossing_sql("pl", f"({ny()} - {ny('ball_y')})", [-150, 150], ["behind", "level", "ahead"]).format(label="depth"))
def rec_ball_depth(spark, folder):
    fr = frames(spark, folder)
    return D.ball_depths(recordings.players(fr), fr).withColumn("seconds", F.round("seconds", 6))


@query(f"""{PL}, g AS (SELECT match_id, frame, player_id, team, {ny()} AS n FROM pl WHERE live),
h AS (SELECT *, count(*) OVER w AS members, max(n) OVER w - min(n) OVER w AS spread, row_number() OVER (w ORDER BY n, player_id) AS up, row_number() OVER (w ORDER BY n DESC, player_id DESC) AS down FROM g WINDOW w AS (PARTITION BY match_id, frame, team))
SELECT match_id, frame, player_id, CASE WHEN members = 1 THEN 'no_teammates' WHEN spread < 236 THEN 'other' WHEN up = 1 THEN 'most_back' WHEN down = 1 THEN 'most_forward' WHEN members = 3 THEN 'mid' ELSE 'other' END AS depth_role FROM h""")
def rec_depth_role(spark, folder):
    return D.depth_roles(players(spark, folder)).select("match_id", "frame", "player_id", "depth_role")


@query(f"""{PL}, g AS (SELECT match_id, frame, team, player_id, sqrt((x - ball_x) ** 2 + (y - ball_y) ** 2) AS d FROM pl)
SELECT match_id, frame, player_id, round(d, 6) AS ball_distance, CAST(row_number() OVER (PARTITION BY match_id, frame, team ORDER BY d, player_id) AS INT) AS ball_rank FROM g""")
def rec_ball_proximity(spark, folder):
    fr = frames(spark, folder)
    return D.distance_rank(recordings.players(fr), fr).select("match_id", "frame", "player_id", F.round("ball_distance", 6).alias("ball_distance"), "ball_rank")


@query(f"""WITH RECURSIVE {SQL_PLAYERS}, g AS (SELECT match_id, frame, team, player_id, CAST(round(sqrt((x - ball_x) ** 2 + (y - ball_y) ** 2) * 1000) AS BIGINT) AS d FROM pl),
q AS (SELECT match_id, team, frame, arg_min(player_id, (d, player_id)) AS leader, (list_sort(list(d)))[2] - min(d) AS lead FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1),
n AS (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY frame) AS rn FROM q),
f AS (
  SELECT match_id, team, frame, rn, leader AS holding, CAST(NULL AS BIGINT) AS rival, CAST(NULL AS BIGINT) AS since FROM n WHERE rn = 1
  UNION ALL
  SELECT n.match_id, n.team, n.frame, n.rn,
    CASE WHEN n.leader = f.holding OR n.lead <= 250000 OR f.rival IS DISTINCT FROM n.leader OR n.frame - f.since < 4 THEN f.holding ELSE n.leader END,
    CASE WHEN n.leader = f.holding OR n.lead <= 250000 THEN NULL WHEN f.rival IS DISTINCT FROM n.leader THEN n.leader WHEN n.frame - f.since >= 4 THEN NULL ELSE f.rival END,
    CASE WHEN n.leader = f.holding OR n.lead <= 250000 THEN NULL WHEN f.rival IS DISTINCT FROM n.leader THEN n.frame WHEN n.frame - f.since >= 4 THEN NULL ELSE f.since END
  FROM f JOIN n ON n.match_id = f.match_id AND n.team = f.team AND n.rn = f.rn + 1)
SELECT match_id, team, frame, holding AS first_man FROM f""")
def rec_first_man(spark, folder):
    """The first man of each team of two or more: nearest to the ball, debounced by a lead of 250 held for 0.35 s (four frames)."""
    fr = frames(spark, folder)
    near = D.distance_rank(recordings.players(fr), fr).withColumn("d", F.round(F.col("ball_distance") * 1000).cast("long"))
    by_rank = [F.max(F.when(F.col("ball_rank") == r, F.col(c))).alias(n) for r, c, n in ((1, "player_id", "leader"), (1, "d", "d1"), (2, "d", "d2"))]
    lead = near.groupBy("match_id", "team", "frame").agg(*by_rank).where("d2 IS NOT NULL").withColumn("lead", F.col("d2") - F.col("d1")).withColumn("id", F.col("frame"))
    held = folds.ordered_fold(lead, ["match_id", "team"], ["frame", "id"], ["leader", "lead"], lambda: (None, None, None), folds.role_debounce(4, 250_000), folds.nothing, "match_id long, team int, frame long, id long, first_man long")
    return held.drop("id")


@query(f"""{PL}, {spans_sql('pl', 'match_id, player_id', 'live AND ball_z BETWEEN 97.75 AND 600 AND sqrt((x - ball_x) ** 2 + (y - ball_y) ** 2) <= 129.85 AND abs(ball_z - z) <= 220')}
SELECT match_id, player_id, island, "start", "end", n_samples FROM sp WHERE state AND "end" - "start" >= 1.0""")
def rec_ball_carry(spark, folder):
    fr = frames(spark, folder)
    return D.ball_carries(recordings.players(fr), fr)


@query(f"""{PL}, {SQL_DEMOS}, a AS (SELECT pl.match_id, pl.player_id, pl.frame, pl.t, coalesce(bool_or(victim IS NOT NULL), false) AS down FROM pl LEFT JOIN de ON de.match_id = pl.match_id AND victim = player_id AND pl.frame - de.frame BETWEEN 0 AND 29 GROUP BY ALL),
{spans_sql('a', 'match_id, player_id', "CASE WHEN down THEN 'demolished' ELSE 'tracked' END")} SELECT * FROM sp""")
def rec_player_activity(spark, folder):
    """Spans in which a player is tracked or demolished (the 30 frames from a demolition on)."""
    fr = frames(spark, folder)
    down = matching.in_window(demos(spark, folder).select("match_id", F.col("victim").alias("player_id"), F.col("frame").alias("at")), recordings.players(fr).select("match_id", "player_id", "frame"), M.PLAYER, "at", "frame", 0, 29)
    rows = matching.flag_exists(recordings.players(fr).select("match_id", "player_id", "frame", "t"), down, ["match_id", "player_id", "frame"], "down")
    return temporal.spans(rows, M.PLAYER, ["frame"], "t", F.when(F.col("down") == 1, "demolished").otherwise("tracked"))


# --- touches and what follows them


@query(f"{TO}, {SQL_PASSES} SELECT match_id, frame, t, team, passer, receiver, round(travel, 6) AS travel FROM pa")
def rec_pass(spark, folder):
    return D.passes(touches(spark, folder)).withColumn("travel", F.round("travel", 6))


@query(f"{TO}, {SQL_PASSES}, {SQL_ONE_TIMERS} SELECT * FROM ot")
def rec_one_timer(spark, folder):
    fr = frames(spark, folder)
    return D.one_timers(recordings.touches(fr), fr)


@query(f"{FR}, {SQL_BOUNCES} SELECT * FROM bo")
def rec_backboard(spark, folder):
    fr = frames(spark, folder)
    return D.backboard_bounces(fr, recordings.touches(fr))


@query(f"""{TO}, w AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY match_id ORDER BY t, frame, player_id), t + 3.0), t + 3.0) AS until FROM tc)
SELECT w.match_id, w.frame, w.t, player_id, team, min(f.frame) AS resolved_frame FROM w JOIN fr f ON f.match_id = w.match_id AND f.live AND f.t - w.t BETWEEN 0 AND 3.0 AND f.t <= until
WHERE abs(x) >= 1600 AND {ny()} >= 128 AND abs(f.ball_x) <= 1400 AND abs(x) - abs(f.ball_x) >= 500 AND {ny('f.ball_y')} >= 2300 GROUP BY 1, 2, 3, 4, 5""")
def rec_center(spark, folder):
    fr = frames(spark, folder)
    return D.centers(recordings.touches(fr), fr)


@query(f"""{TO}, c AS (SELECT *, CASE WHEN lag(t) OVER ({TW}) IS NULL OR lag(player_id) OVER ({TW}) <> player_id OR t - lag(t) OVER ({TW}) > 2.5 THEN 1 ELSE 0 END AS new FROM tc),
e AS (SELECT *, sum(new) OVER ({TW}) AS ep FROM c)
SELECT match_id, any_value(player_id) AS player_id, any_value(team) AS team, min(t) AS "start", max(t) AS "end", count(*) AS n_touches FROM e GROUP BY match_id, ep HAVING count(*) >= 2 AND max(t) - min(t) >= 1""")
def rec_controlled_play(spark, folder):
    return D.controlled_plays(touches(spark, folder))


@query(f"""{PT}, b AS (SELECT match_id, frame, player_id, z AS car_z FROM pl), c AS (SELECT *, CASE WHEN lag(t) OVER ({TW}) IS NULL OR lag(player_id) OVER ({TW}) <> player_id OR t - lag(t) OVER ({TW}) > 3.0 THEN 1 ELSE 0 END AS new FROM tc JOIN b USING (match_id, frame, player_id)),
e AS (SELECT *, sum(new) OVER ({TW}) AS ep FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY match_id, ep ORDER BY t, frame) AS num FROM e)
SELECT match_id, min(player_id) AS player_id, min(t) AS "start", max(t) AS "end", count(*) AS n_touches, CAST(sum((car_z > 100)::INT) AS BIGINT) AS n_air FROM n GROUP BY match_id, ep
HAVING count(*) >= 3 AND sum((car_z > 100)::INT) >= 2 AND sum((num > 1 AND z < 300)::INT) = 0 AND max(t) - min(t) >= 0.65""")
def rec_air_dribble(spark, folder):
    fr = frames(spark, folder)
    return M.air_dribbles(recordings.touches(fr), recordings.players(fr))


@query(f"""{PL}, r AS (SELECT *, lag(dodging, 1, false) OVER ({PW}) AS was FROM pl), d AS (SELECT match_id, player_id, team, frame, t, z AS z0, sqrt(vx * vx + vy * vy) AS v0 FROM r WHERE dodging AND NOT was AND z BETWEEN 28 AND 320),
j AS (SELECT d.*, p.t AS landed, p.up_z, sqrt(p.vx * p.vx + p.vy * p.vy) AS v1 FROM d JOIN pl p ON p.match_id = d.match_id AND p.player_id = d.player_id AND p.z <= 20 AND p.up_z >= 0.15 AND p.t - d.t BETWEEN 0 AND 0.35
  QUALIFY row_number() OVER (PARTITION BY d.match_id, d.player_id, d.frame ORDER BY p.t) = 1),
s AS (SELECT *, (1 - greatest(0, least(1, (landed - t - 0.08) / (0.35 - 0.08)))) * 0.35 + (1 - greatest(0, least(1, (z0 - 28) / (220 - 28)))) * 0.25
  + greatest(greatest(0, least(1, (v1 - v0 - 80) / (550 - 80))), greatest(0, least(1, (v1 - 900) / (1800 - 900))) * 0.8) * 0.25 + greatest(0, least(1, (up_z - 0.3) / (0.95 - 0.3))) * 0.15 AS confidence FROM j)
SELECT match_id, player_id, team, frame, t, landed, round(confidence, 6) AS confidence FROM s WHERE confidence >= 0.45""")
def rec_wavedash(spark, folder):
    rows = D.wavedashes(players(spark, folder))
    return rows.select("match_id", "player_id", "team", "frame", "t", "landed", F.round("confidence", 6).alias("confidence"))


@query(f"""{PT}, fl AS (SELECT match_id, frame, dt, ball_x, ball_y, ball_z, ball_vx, ball_vy, ball_vz, coalesce(lag(ball_vx) OVER ({MW}), 0) AS wx, coalesce(lag(ball_vy) OVER ({MW}), 0) AS wy, coalesce(lag(ball_vz) OVER ({MW}), 0) AS wz FROM fr),
b AS (SELECT match_id, frame, player_id, x AS cx, y AS cy, z AS cz FROM pl),
r AS (SELECT *, sqrt((ball_vx - wx) ** 2 + (ball_vy - wy) ** 2 + (ball_vz - wz + 650 * dt) ** 2) AS residual, {BALL_SPEED} AS speed, CASE WHEN team = 0 THEN 5120.0 ELSE -5120.0 END AS side, {GT} AS tt FROM tc JOIN fl USING (match_id, frame) JOIN b USING (match_id, frame, player_id)),
q AS (SELECT *, ball_y + side AS oy, side - ball_y AS gy FROM r)
SELECT match_id, frame, touch_id, player_id, CASE WHEN residual <= 320 THEN 'control' WHEN residual < 900 THEN 'medium' ELSE 'hard' END AS kind, CASE WHEN cz < 100 THEN 'ground' ELSE 'air' END AS height,
  CASE WHEN cz >= 120 AND (abs(cx) >= 3600 OR (abs(cy) >= 5000 AND abs(cx) > 900)) THEN 'wall' WHEN cz <= 20 THEN 'ground' ELSE 'air' END AS surface,
  CASE WHEN ball_vy <> 0 AND tt >= 0 AND speed >= 1000 AND abs(ball_x + ball_vx * tt) <= 892.755 AND ball_z + ball_vz * tt - 325 * tt * tt BETWEEN 0 AND 642.775 THEN 'shot'
    WHEN {ny('ball_y')} <= -1706.7 AND speed >= 1300 AND (ball_vx * ball_x + ball_vy * oy) / nullif(speed * sqrt(ball_x * ball_x + oy * oy), 0) >= 0.2 THEN 'clear'
    WHEN speed >= 1500 AND (ball_vx * -ball_x + ball_vy * gy) / nullif(speed * sqrt(ball_x * ball_x + gy * gy), 0) >= 0.3 THEN 'boom' ELSE 'none' END AS action FROM q""")
def rec_touch_kind(spark, folder):
    fr = frames(spark, folder)
    return M.touch_kinds(recordings.touches(fr), fr, recordings.players(fr)).select("match_id", "frame", "touch_id", "player_id", "kind", "height", "surface", "action")


SQL_CLAIMS = f"""cl0 AS (SELECT match_id, frame, dt, ball_x, ball_y, ball_z, ball_vx, ball_vy, ball_vz, {', '.join(f'lag(ball_{c}) OVER ({MW}) AS p_{c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))} FROM fr),
cl1 AS (SELECT *, sqrt((ball_x - (p_x + p_vx * dt)) ** 2 + (ball_y - (p_y + p_vy * dt)) ** 2 + (ball_z - (p_z + p_vz * dt + dt * dt * -325)) ** 2) AS off_, sqrt((ball_vx - p_vx) ** 2 + (ball_vy - p_vy) ** 2 + (ball_vz - p_vz - dt * -650) ** 2) AS turned FROM cl0 WHERE p_x IS NOT NULL),
cl2 AS (SELECT pl.*, off_, turned, greatest(0, sqrt((x - c.ball_x) ** 2 + (y - c.ball_y) ** 2 + (z - c.ball_z) ** 2) - 180) AS gap FROM pl JOIN cl1 c USING (match_id, frame)),
cl AS (SELECT match_id, frame, t, player_id, team, gap, gap + CASE WHEN gap > 5 THEN 100 ELSE 0 END - CASE WHEN dodging THEN 1 ELSE 0 END AS score, dodging FROM cl2 WHERE (gap <= 5 AND (off_ >= 25 OR turned >= 15)) OR (gap <= 25 AND (off_ >= 500 OR turned >= 1000)))"""


@query(f"""{PL}, {SQL_CLAIMS}
SELECT match_id, frame, player_id, round(gap, 6) AS gap, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY match_id, frame ORDER BY score, gap, dodging DESC, player_id) AS INT) AS claim FROM cl""")
def rec_touch_claims(spark, folder):
    """Who can claim a touch of the ball, in the total order of claims."""
    fr = frames(spark, folder)
    rows = M.touch_candidates(recordings.players(fr), fr, 180.0)
    return rows.select("match_id", "frame", "player_id", F.round("gap", 6).alias("gap"), F.round("score", 6).alias("score"), "claim")


@query(f"""WITH RECURSIVE {SQL_PLAYERS}, {SQL_CLAIMS}, b AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY score, gap, dodging DESC, player_id) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY frame) AS rn FROM b),
f AS (SELECT match_id, player_id, frame, rn, frame AS kept, true AS keep FROM n WHERE rn = 1
  UNION ALL SELECT n.match_id, n.player_id, n.frame, n.rn, CASE WHEN n.frame - f.kept >= 3 THEN n.frame ELSE f.kept END, n.frame - f.kept >= 3 FROM f JOIN n ON n.match_id = f.match_id AND n.player_id = f.player_id AND n.rn = f.rn + 1)
SELECT match_id, player_id, frame FROM f WHERE keep""")
def rec_touch_state(spark, folder):
    """The touches that are accepted: the best claim of a frame, and of a player's only one in 0.25 s (three frames)."""
    fr = frames(spark, folder)
    best = M.touch_candidates(recordings.players(fr), fr, 180.0).where("claim = 1").withColumn("id", F.col("frame"))
    kept = scans.scanned(best, M.PLAYER, ["frame", "id"], [], scans.rate_limit(3), "match_id long, player_id long, frame long, id long")
    return kept.drop("id")


@query(f"""{TO}, e AS (SELECT match_id, frame, t, user_id AS player_id, CASE WHEN event_type = 'view' THEN event_id END AS touch_id FROM fr WHERE event_type IN ('view', 'purchase'))
SELECT e.match_id, e.frame, e.player_id, CASE WHEN e.touch_id IS NOT NULL THEN d.frame ELSE (SELECT max(frame) FROM tc WHERE tc.match_id = e.match_id AND tc.player_id = e.player_id AND tc.frame <= e.frame) END AS touch_frame
FROM e LEFT JOIN tc d ON d.touch_id = e.touch_id""")
def rec_touch_join(spark, folder):
    fr = frames(spark, folder)
    events = fr.where("event_type IN ('view', 'purchase')").select("match_id", "frame", "t", F.col("user_id").alias("player_id"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("touch_id"))
    return M.joined_on_touch(events, recordings.touches(fr)).select("match_id", "frame", "player_id", "touch_frame")


@query(f"""{PT}, {SQL_PASSES}, {SQL_BOUNCES}, {SQL_FIFTY}
SELECT match_id, frame, passer, receiver, CASE WHEN EXISTS (SELECT 1 FROM bo WHERE bo.match_id = pa.match_id AND bo.t > pa.prev_t AND bo.t < pa.t) THEN 'wall' WHEN EXISTS (SELECT 1 FROM ff WHERE ff.match_id = pa.match_id AND ff.t > pa.prev_t AND ff.t < pa.t) THEN 'contested' ELSE 'direct' END AS kind FROM pa""")
def rec_pass_kind(spark, folder):
    rec = recordings.Recording.of(spark, folder)
    found = D.passes(rec.touches, previous_time=True)
    return M.pass_kinds(found, bounces(rec), M.fifty_fifties(rec.touches, rec.frames, rec.players)).select("match_id", "frame", "passer", "receiver", "kind")


# --- contests, contacts, mechanics


@query(f"{PT}, {SQL_FIFTY} SELECT * FROM ff")
def rec_fifty_fifty(spark, folder):
    fr = frames(spark, folder)
    return M.fifty_fifties(recordings.touches(fr), fr, recordings.players(fr))


SQL_PAIRS = f"""mv AS (SELECT *, {', '.join(f'lag({c}) OVER ({PW}) AS p_{c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))} FROM pl),
pr AS (SELECT a.match_id, a.frame, a.t, a.dt, a.player_id AS a, o.player_id AS b, {', '.join(f'{s}.{p}{c} AS {p}{s}{c}' for s in 'ao' for p in ('', 'p_') for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))}
  FROM mv a JOIN mv o ON a.match_id = o.match_id AND a.frame = o.frame AND a.team = 0 AND o.team = 1 AND a.p_x IS NOT NULL AND o.p_x IS NOT NULL)"""
_AT = lambda s, c: f"(p_{s}{c} + ({s}{c} - p_{s}{c}) * (i / 8))"
SQL_SWEPT = f"sw AS (SELECT *, list_min(list_transform(range(0, 9), lambda i: sqrt({' + '.join(f'({_AT(chr(97), c)} - {_AT(chr(111), c)}) ** 2' for c in 'xyz')}))) AS swept FROM pr)"


@query(f"{PL}, {SQL_PAIRS}, {SQL_SWEPT} SELECT match_id, frame, a, b, round(swept, 6) AS swept FROM sw")
def rec_swept_gap(spark, folder):
    return M.swept_gap(M.opposing_pairs(players(spark, folder))).select("match_id", "frame", "a", "b", F.round("swept", 6).alias("swept"))


@query(f"""{PT}, {SQL_FIFTY}, {SQL_PAIRS}, {SQL_SWEPT},
b0 AS (SELECT *, greatest(0, swept - 118) AS gap, sqrt((ox - ax) ** 2 + (oy - ay) ** 2 + (oz - az) ** 2) AS n FROM sw WHERE dt <= 0.18),
b1 AS (SELECT match_id, frame, t, a, b, {', '.join(f'CASE WHEN n > 0 THEN ({p}{s}vx * (ox - ax) + {p}{s}vy * (oy - ay) + {p}{s}vz * (oz - az)) / n ELSE 0 END AS {p}{s}v' for s in 'ao' for p in ('', 'p_'))} FROM b0 WHERE gap <= 35),
b2 AS (SELECT match_id, frame, t, a, b, p_av - p_ov AS closing, greatest(p_av - av, ov - p_ov) AS impulse, p_av - p_ov + greatest(ov - p_ov, 0) * 1.35 + greatest(p_av - av, 0) * 0.35 + CASE WHEN p_av > 0 THEN 220 ELSE 0 END AS sa,
  p_av - p_ov + greatest(p_av - av, 0) * 1.35 + greatest(ov - p_ov, 0) * 0.35 + CASE WHEN p_ov < 0 THEN 220 ELSE 0 END AS sb FROM b1),
b3 AS (SELECT * FROM b2 WHERE closing >= 420 AND impulse >= 180 AND greatest(sa, sb) >= 650 AND abs(sa - sb) >= 175),
b4 AS (SELECT *, lag(frame) OVER (PARTITION BY match_id, a, b ORDER BY frame) AS pf FROM b3)
SELECT match_id, frame, t, CASE WHEN sa >= sb THEN a ELSE b END AS player_id, CASE WHEN sa >= sb THEN b ELSE a END AS victim, round(greatest(sa, sb), 6) AS score FROM b4
WHERE (pf IS NULL OR frame - pf > 10) AND NOT EXISTS (SELECT 1 FROM ff WHERE ff.match_id = b4.match_id AND ff.p0 = b4.a AND ff.p1 = b4.b AND b4.t - (ff.t - 0.35) BETWEEN 0 AND 0.7)""")
def rec_bump(spark, folder):
    rec = recordings.Recording.of(spark, folder)
    return M.bumps(rec.players, M.fifty_fifties(rec.touches, rec.frames, rec.players)).withColumn("score", F.round("score", 6))


@query(f"""{PT}, r0 AS (SELECT *, {ny()} AS bny, lag(team) OVER ({TW}) AS before FROM tc), r1 AS (SELECT *, min(CASE WHEN before <> team THEN t END) OVER ({TW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lost FROM r0),
r2 AS (SELECT match_id, frame, t, team, bny FROM r1 WHERE before <> team AND bny <= -128 AND (lost IS NULL OR lost - t >= 0.75)),
r3 AS (SELECT r2.*, p.team AS side, CASE WHEN r2.team = 0 THEN p.y ELSE -p.y END AS n FROM r2 JOIN pl p USING (match_id, frame))
SELECT match_id, frame, t, team, CAST(sum((side = team AND n >= bny - 900)::INT) AS BIGINT) AS attackers, CAST(sum((side <> team AND n >= bny + 150)::INT) AS BIGINT) AS defenders FROM r3 GROUP BY 1, 2, 3, 4
HAVING sum((side = team AND n >= bny - 900)::INT) >= 2 AND sum((side <> team AND n >= bny + 150)::INT) >= 1""")
def rec_rush(spark, folder):
    fr = frames(spark, folder)
    return M.rushes(recordings.touches(fr), recordings.players(fr))


@query(f"{PL}, {SQL_DODGES} SELECT match_id, player_id, frame, round(delta, 6) AS delta, direction FROM dg")
def rec_dodge(spark, folder):
    return M.dodges(players(spark, folder)).select("match_id", "player_id", "frame", F.round("delta", 6).alias("delta"), "direction")


@query(f"{TO}, {SQL_BOUNCES}, {SQL_DOUBLE_TAPS} SELECT * FROM dbl")
def rec_double_tap(spark, folder):
    fr = frames(spark, folder)
    tc = recordings.touches(fr)
    return M.double_taps(D.backboard_bounces(fr, tc), tc, fr)


@query(f"{PT}, {SQL_DODGES}, {SQL_VOLLEYS} SELECT * FROM hv")
def rec_half_volley(spark, folder):
    fr = frames(spark, folder)
    return M.half_volleys(recordings.touches(fr), fr, M.dodges(recordings.players(fr)))


@query(f"""{PL}, {SQL_DEMOS}, p AS (SELECT *, lag(frame) OVER (PARTITION BY match_id, attacker, victim ORDER BY frame) AS pf FROM de) SELECT match_id, frame, t, attacker, victim FROM p WHERE pf IS NULL OR frame - pf > 8""")
def rec_demolition(spark, folder):
    return D.demolitions(demos(spark, folder))


@query(f"""{PL}, {SQL_DEMOS}, {SQL_STARTS}
SELECT ks.match_id, ks.frame, player_id, 'kickoff' AS reason FROM ks JOIN pl USING (match_id, frame)
UNION ALL SELECT match_id, min(frame), player_id, 'demolition' FROM (SELECT de.match_id, de.victim AS player_id, de.frame AS down, p.frame FROM de JOIN pl p ON p.match_id = de.match_id AND p.player_id = de.victim AND p.t - de.t BETWEEN 3.2 AND 4.2) GROUP BY match_id, player_id, down""")
def rec_boost_respawn(spark, folder):
    fr = frames(spark, folder)
    return M.boost_respawns(recordings.players(fr), demos(spark, folder), M.kickoff_starts(fr))


SQL_NEAR = """nr0 AS (SELECT match_id, player_id, frame, t, CAST(round(sqrt((x - ball_x) ** 2 + (y - ball_y) ** 2 + (z - ball_z) ** 2) * 1000) AS BIGINT) AS d, row_number() OVER (PARTITION BY match_id, player_id ORDER BY frame) AS rn FROM pl),
nr1 AS (SELECT match_id, player_id, frame, t, rn, CASE WHEN d < 220000 THEN frame END AS entered FROM nr0 WHERE rn = 1
  UNION ALL SELECT n.match_id, n.player_id, n.frame, n.t, n.rn, CASE WHEN f.entered IS NOT NULL THEN CASE WHEN n.d > 360000 OR n.frame - f.entered > 10 THEN NULL ELSE f.entered END WHEN n.d < 220000 THEN n.frame END
  FROM nr1 f JOIN nr0 n ON n.match_id = f.match_id AND n.player_id = f.player_id AND n.rn = f.rn + 1)"""


@query(f"""WITH RECURSIVE {SQL_PLAYERS}, {SQL_TOUCHES}, {SQL_NEAR}, {spans_sql('nr1', 'match_id, player_id', 'CASE WHEN entered IS NOT NULL THEN 1 ELSE 0 END')}
SELECT match_id, player_id, "start", "end" FROM sp WHERE state = 1 AND NOT EXISTS (SELECT 1 FROM tc WHERE tc.match_id = sp.match_id AND tc.t - sp."start" BETWEEN 0 AND 1.5 AND tc.t <= sp."end")""")
def rec_whiff(spark, folder):
    """Spells at the ball (entered below 220, left above 360 or after a second) without a touch."""
    fr = frames(spark, folder)
    near = recordings.players(fr).join(fr.select("match_id", "frame", *M.BALL), ["match_id", "frame"])
    near = near.select("match_id", "player_id", "frame", F.col("frame").alias("id"), F.round(C.length(C.subtract(M.xyz(""), M.xyz("ball_"))) * 1000).cast("long").alias("d"))
    inside = scans.scanned(near, M.PLAYER, ["frame", "id"], ["d"], scans.hysteresis(220_000, 360_000, 10), "match_id long, player_id long, frame long, id long, inside int")
    spells = temporal.spans(inside.withColumn("t", F.col("frame").cast("double") / 10), M.PLAYER, ["frame"], "t", F.col("inside")).where("state = 1").select("match_id", "player_id", "start", "end")
    return M.whiffs(spells, recordings.touches(fr))


_FITS = "list_filter(wait, lambda x: n.frame - x.frame <= 3 AND x.source <> n.source AND (x.kind = n.kind OR x.kind = -1 OR n.kind = -1))"
_NEAREST = f"list_sort(list_transform({_FITS}, lambda x: {{'gap': n.frame - x.frame, 'id': x.id}}))[1].id"


@query(f"""WITH RECURSIVE {SQL_FRAMES}, {SQL_PICKUPS},
q AS (SELECT match_id, player_id, CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS taken, list_filter([{{'frame': CAST(0 AS BIGINT), 'id': CAST(0 AS BIGINT), 'source': 0, 'kind': 0}}], lambda x: false) AS wait FROM pu WHERE id = 1
  UNION ALL SELECT match_id, player_id, id, taken, CASE WHEN taken IS NULL THEN list_append(list_filter(wait, lambda x: frame - x.frame <= 3), {{'frame': frame, 'id': id, 'source': source, 'kind': kind}}) ELSE list_filter(wait, lambda x: frame - x.frame <= 3 AND x.id <> taken) END FROM (
    SELECT n.match_id, n.player_id, n.id, n.frame, n.source, n.kind, wait, {_NEAREST} AS taken FROM q JOIN pu n ON n.match_id = q.match_id AND n.player_id = q.player_id AND n.id = q.id + 1)),
g AS (SELECT pu.*, coalesce(taken, pu.id) AS pickup FROM pu JOIN q USING (match_id, player_id, id)),
h AS (SELECT match_id, player_id, pickup, count(DISTINCT source) AS n, max(source) AS src, coalesce(max(frame) FILTER (source = 1), max(frame)) AS frame, coalesce(max(kind) FILTER (kind >= 0), 1) AS kind, max(before) AS before, max(y) AS y, max(team) AS team FROM g GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN kind = 1 THEN 255 ELSE 30.6 END AS nominal FROM h)
SELECT match_id, player_id, frame, kind, CASE WHEN n = 2 THEN 'both' WHEN src = 0 THEN 'reported_only' ELSE 'inferred_only' END AS detection, round(CASE WHEN before IS NOT NULL THEN least(nominal, 255 - before) END, 3) AS collected,
  round(nominal - CASE WHEN before IS NOT NULL THEN least(nominal, 255 - before) END, 3) AS overfill, {ny()} > 0 AS is_steal FROM c""")
def rec_boost_pickup(spark, folder):
    """Pickups as pads report them and as boosts jump, matched one to one."""
    fr = frames(spark, folder)
    found = pickups.boost_pickups(recordings.pad_reports(fr), recordings.boost_jumps(fr))
    return found.withColumns({c: F.round(c, 3) for c in ("collected", "overfill")})


# --- kickoffs and goals


@query(f"""{PT}, {SQL_STARTS}, k0 AS (SELECT tc.*, s.frame AS start_frame FROM tc ASOF JOIN ks s ON tc.match_id = s.match_id AND tc.frame > s.frame),
k1 AS (SELECT match_id, start_frame, frame AS touch_frame, t AS touch_t, player_id AS toucher, team FROM k0 QUALIFY row_number() OVER (PARTITION BY match_id, start_frame ORDER BY t, frame) = 1),
k2 AS (SELECT k1.match_id, start_frame, p.player_id AS who, p.team AS side, abs(p.x) AS ax, abs(p.y) AS ay, sqrt(p.x * p.x + p.y * p.y) AS far FROM k1 JOIN pl p ON p.match_id = k1.match_id AND p.frame = start_frame),
k3 AS (SELECT match_id, start_frame, arg_min(who, (far, who)) FILTER (side = 0) AS taker0, arg_min(who, (far, who)) FILTER (side = 1) AS taker1 FROM k2 GROUP BY 1, 2),
k4 AS (SELECT k1.*, r.frame AS resolved_frame, greatest(-5120, least(5120, ball_y + ball_vy * 0.5)) AS y FROM k1 JOIN fr r ON r.match_id = k1.match_id AND r.t - touch_t BETWEEN 1.25 AND 2.0 QUALIFY row_number() OVER (PARTITION BY k1.match_id, start_frame ORDER BY r.frame) = 1)
SELECT k4.match_id, start_frame, touch_frame, toucher, team, resolved_frame, abs(y) / 5120 AS strength, CASE WHEN abs(y) < 256 THEN 'neutral' WHEN abs(y) / 5120 >= 0.5 THEN 'strong' WHEN abs(y) / 5120 >= 0.25 THEN 'clear' ELSE 'narrow' END AS win,
  CASE WHEN abs(y) >= 256 THEN CAST(y < 0 AS INT) END AS winner, taker0, taker1, CASE WHEN ax <= 350 AND ay >= 4300 THEN 'center' WHEN ax <= 900 AND ay >= 3300 THEN 'off_center' WHEN ax >= 1500 AND ay <= 3300 THEN 'diagonal' ELSE 'other' END AS spawn
FROM k4 JOIN k3 USING (match_id, start_frame) JOIN k2 ON k2.match_id = k4.match_id AND k2.start_frame = k4.start_frame AND k2.who = toucher""")
def rec_kickoff(spark, folder):
    rec = recordings.Recording.of(spark, folder)
    return M.kickoffs(M.kickoff_starts(rec.frames), rec.touches, rec.frames, rec.players)


SQL_CONTEXT = f"""gc0 AS (SELECT g.match_id, g.frame, g.t, g.team, b.t AS touch_t, b.frame AS touch_frame, b.player_id AS scorer, b.touch_id, b.z AS touch_z, CASE WHEN g.team = 0 THEN b.y ELSE -b.y END AS touch_ny FROM go g ASOF LEFT JOIN tc b ON g.match_id = b.match_id AND g.team = b.team AND g.frame > b.frame),
gc1 AS (SELECT c.match_id, c.frame, max(CASE WHEN c.team = 0 THEN p.y ELSE -p.y END) AS last_defender_ny, min(touch_ny - CASE WHEN c.team = 0 THEN p.y ELSE -p.y END) AS margin, min(sqrt((p.x - p.ball_x) ** 2 + (p.y - p.ball_y) ** 2 + (p.z - p.ball_z) ** 2)) AS guard_distance FROM gc0 c JOIN pl p ON p.match_id = c.match_id AND p.frame = c.frame AND p.team = 1 - c.team GROUP BY 1, 2),
gc2 AS (SELECT c.match_id, c.frame, c.t, f.t AS at_t, CAST(round(f.dt * 10) AS BIGINT) AS tenths, CASE WHEN c.team = 0 THEN f.ball_y ELSE -f.ball_y END AS n FROM gc0 c JOIN fr f ON f.match_id = c.match_id AND f.t - (c.t - 12.0) BETWEEN 0 AND 12.0 AND f.t < c.t),
gc3 AS (SELECT match_id, frame, CAST(sum(CASE WHEN n > 0 THEN tenths ELSE 0 END) AS BIGINT) AS off_half, CAST(sum(CASE WHEN n < 0 THEN tenths ELSE 0 END) AS BIGINT) AS def_half, CAST(sum(CASE WHEN n > 2300 THEN tenths ELSE 0 END) AS BIGINT) AS off_third, CAST(sum(CASE WHEN n < -2300 THEN tenths ELSE 0 END) AS BIGINT) AS def_third, coalesce(max(CASE WHEN n <= 0 THEN at_t END), min(at_t)) AS since FROM gc2 GROUP BY 1, 2),
gc AS (SELECT gc0.*, last_defender_ny, margin, guard_distance, off_half, def_half, off_third, def_third, CASE WHEN t - since <= 4 AND (def_half >= 40 OR def_third >= 10) THEN 'counter_attack' WHEN t - since >= 6 AND off_half >= 70 AND off_third >= 35 THEN 'sustained_pressure' ELSE 'other' END AS build_up
  FROM gc0 LEFT JOIN gc1 USING (match_id, frame) LEFT JOIN gc3 USING (match_id, frame))"""
PTG = f"{PT}, {SQL_GOALS}"


def contexts(rec):
    return M.goal_contexts(rec.goals.select("match_id", "frame", "t", "team"), rec.touches, rec.players, rec.frames)


@query(f"{PTG}, {SQL_CONTEXT} SELECT match_id, frame, team, touch_t, scorer, touch_z, touch_ny, last_defender_ny, margin, round(guard_distance, 6) AS guard_distance FROM gc")
def rec_goal_context(spark, folder):
    rows = contexts(recordings.Recording.of(spark, folder)).select("match_id", "frame", "team", "touch_t", "scorer", "touch_z", "touch_ny", "last_defender_ny", "margin", "guard_distance")
    return rows.withColumn("guard_distance", F.round("guard_distance", 6))


@query(f"{PTG}, {SQL_CONTEXT} SELECT match_id, frame, off_half, def_half, off_third, def_third, build_up FROM gc")
def rec_goal_build_up(spark, folder):
    return contexts(recordings.Recording.of(spark, folder)).select("match_id", "frame", "off_half", "def_half", "off_third", "def_third", "build_up")


def _tag_sql(name: str, rel: str, who: str, within: float, time: str = "t") -> str:
    return f"SELECT DISTINCT gc.match_id, gc.frame, '{name}' AS tag FROM gc JOIN {rel} e ON e.match_id = gc.match_id AND e.{who} = gc.scorer AND gc.t - e.{time} BETWEEN 0 AND {within}"


@query(f"""{PTG}, {SQL_CONTEXT}, {SQL_PASSES}, {SQL_ONE_TIMERS}, {SQL_BOUNCES}, {SQL_DOUBLE_TAPS}, {SQL_DODGES}, {SQL_VOLLEYS}, {SQL_DEMOS}, {SQL_STARTS},
runs0 AS (SELECT *, CASE WHEN lag(team) OVER ({TW}) IS DISTINCT FROM team THEN 1 ELSE 0 END AS new FROM tc), runs AS (SELECT *, sum(new) OVER ({TW}) AS poss FROM runs0),
high AS (SELECT match_id, poss FROM runs GROUP BY 1, 2 HAVING max(z) >= 700),
kk AS (SELECT gc.match_id, gc.frame, gc.t, gc.team, ks.frame AS k_fr, ks.t AS k_t FROM gc ASOF LEFT JOIN ks ON gc.match_id = ks.match_id AND gc.frame > ks.frame),
kf AS (SELECT match_id, k_fr, min(t) AS first_t FROM (SELECT tc.match_id, tc.t, ks.frame AS k_fr FROM tc ASOF JOIN ks ON tc.match_id = ks.match_id AND tc.frame > ks.frame) GROUP BY 1, 2),
kq AS (SELECT kk.*, first_t FROM kk JOIN kf USING (match_id, k_fr) WHERE t >= first_t AND t - first_t < 12),
kt AS (SELECT kq.match_id, kq.frame, kq.team, tc.t AS at_t, tc.frame AS at_fr, tc.team AS by_team, max(CASE WHEN tc.team = kq.team THEN tc.frame END) OVER (PARTITION BY kq.match_id, kq.frame, kq.team ORDER BY tc.t, tc.frame) AS broke FROM kq JOIN tc ON tc.match_id = kq.match_id AND tc.t >= first_t AND tc.t <= kq.t),
kg AS (SELECT kq.match_id, kq.frame, EXISTS (SELECT 1 FROM (SELECT max(at_t) - min(at_t) AS held FROM kt WHERE kt.match_id = kq.match_id AND kt.frame = kq.frame AND kt.team = kq.team AND by_team <> kt.team GROUP BY coalesce(broke, -1)) WHERE round(held, 6) > 0.35) AS settled,
  EXISTS (SELECT 1 FROM fr WHERE fr.match_id = kq.match_id AND fr.t >= first_t AND fr.t <= kq.t AND CASE WHEN kq.team = 0 THEN ball_y ELSE -ball_y END < -1280) AS far_back FROM kq)
SELECT match_id, frame, 'aerial' AS tag FROM gc WHERE touch_z >= 600
UNION ALL SELECT match_id, frame, 'long_distance' FROM gc WHERE touch_ny <= 1024
UNION ALL SELECT match_id, frame, 'own_half' FROM gc WHERE touch_ny <= 0 AND t - touch_t <= 8
UNION ALL SELECT match_id, frame, 'empty_net' FROM gc WHERE touch_ny <= 3600 AND margin >= 700 AND guard_distance >= 1000
UNION ALL SELECT match_id, frame, build_up FROM gc WHERE build_up <> 'other'
UNION ALL SELECT gc.match_id, gc.frame, 'high_aerial' FROM gc JOIN runs USING (touch_id) JOIN high ON high.match_id = runs.match_id AND high.poss = runs.poss
UNION ALL {_tag_sql('one_timer', 'ot', 'receiver', 3.0)} UNION ALL {_tag_sql('double_tap', 'dbl', 'player_id', 3.0)} UNION ALL {_tag_sql('half_volley', 'hv', 'player_id', 3.0)}
UNION ALL SELECT gc.match_id, gc.frame, 'passing' FROM gc JOIN pa ON pa.match_id = gc.match_id AND pa.frame = gc.touch_frame AND pa.receiver = gc.scorer WHERE gc.t - gc.touch_t <= 3
UNION ALL SELECT gc.match_id, gc.frame, 'flip_into_ball' FROM gc JOIN pl ON pl.match_id = gc.match_id AND pl.frame = gc.touch_frame AND pl.player_id = gc.scorer WHERE pl.dodging AND gc.t - gc.touch_t <= 3
UNION ALL SELECT DISTINCT kk.match_id, kk.frame, 'demo' FROM kk JOIN de ON de.match_id = kk.match_id AND de.attacker % 2 = kk.team AND kk.t - de.t BETWEEN 0 AND 5.25 WHERE kk.k_t IS NULL OR de.t >= kk.k_t - 0.05
UNION ALL SELECT match_id, frame, 'kickoff' FROM kg WHERE NOT settled AND NOT far_back""")
def rec_goal_tags(spark, folder):
    """The tags of a goal: by its context, its build-up, its possession, its scorer's mechanics and the last kickoff."""
    rec = recordings.Recording.of(spark, folder)
    goal = rec.stream("contexts", contexts)
    as_player = lambda df, c: df.select("match_id", F.col(c).alias("player_id"), "t")
    mechanics = {
        "one_timer": (as_player(D.one_timers(rec.touches, rec.frames), "receiver"), 3.0),
        "double_tap": (M.double_taps(bounces(rec), rec.touches, rec.frames), 3.0),
        "half_volley": (M.half_volleys(rec.touches, rec.frames, rec.stream("dodges", dodges)), 3.0),
    }
    starts = rec.stream("kickoff_starts", lambda r: M.kickoff_starts(r.frames))
    downs = demolished(rec.frames).select("match_id", "t", (F.col("attacker") % 2).cast("int").alias("team"))
    parts = [
        M.context_tags(goal),
        M.high_aerial_goals(goal, rec.touches),
        M.mechanic_tags(goal, mechanics),
        M.scoring_touch_tags(goal, rec.players, D.passes(rec.touches)),
        M.demolition_goals(goal, downs, starts),
        M.kickoff_goals(goal, starts, rec.touches, rec.frames),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(f"""WITH RECURSIVE {SQL_FRAMES}, {SQL_GOALS}, p AS (SELECT *, CAST(round(t * 1000) AS BIGINT) AS ms, row_number() OVER ({TW}) AS rn FROM go),
f AS (SELECT match_id, rn, frame, t, team, true AS kept, ms AS lms, team AS lteam, score0 AS l0, score1 AS l1 FROM p WHERE rn = 1
  UNION ALL SELECT match_id, rn, frame, t, team, NOT rep, CASE WHEN rep THEN lms ELSE ms END, CASE WHEN rep THEN lteam ELSE team END, CASE WHEN rep THEN l0 ELSE score0 END, CASE WHEN rep THEN l1 ELSE score1 END FROM (
    SELECT p.*, lms, lteam, l0, l1, CASE WHEN score0 IS NOT NULL AND score1 IS NOT NULL AND l0 IS NOT NULL AND l1 IS NOT NULL THEN score0 = l0 AND score1 = l1 ELSE p.team = lteam AND ms - lms <= 3000 END AS rep
    FROM f JOIN p ON p.match_id = f.match_id AND p.rn = f.rn + 1))
SELECT match_id, frame, t, team FROM f WHERE kept""")
def rec_distinct_goals(spark, folder):
    return D.distinct_goals(goals(spark, folder)).select("match_id", "frame", "t", "team")


@query(f"""{FR}, {SQL_GOALS}, x AS (SELECT match_id, frame, CAST(user_id % 2 AS INT) AS team, user_id FROM fr WHERE k % 5 < 2), c AS (SELECT match_id, frame, CAST(user_id % 2 AS INT) AS team, user_id FROM fr WHERE k % 4 > 0)
SELECT go.match_id, go.frame, coalesce(x.user_id, c.user_id) AS scorer, CASE WHEN x.user_id IS NOT NULL THEN 'explosion' WHEN c.user_id IS NOT NULL THEN 'counter' ELSE 'none' END AS source FROM go LEFT JOIN x USING (match_id, frame, team) LEFT JOIN c USING (match_id, frame, team)""")
def rec_goal_scorer(spark, folder):
    fr = frames(spark, folder)
    signal = fr.select("match_id", "frame", F.expr("CAST(user_id % 2 AS INT)").alias("team"), F.col("user_id").alias("player_id"), "k")
    return V.goal_scorers(recordings.goals(fr), signal.where("k % 5 < 2"), signal.where("k % 4 > 0")).select("match_id", "frame", "scorer", "source")


# --- raw changes


@query(f"{FR} SELECT match_id, user_id AS player_id, CAST(min(user_id % 2) AS INT) AS team, CAST(row_number() OVER (PARTITION BY match_id ORDER BY CAST(user_id AS VARCHAR)) AS INT) AS slot FROM fr WHERE frame <= 100 GROUP BY match_id, user_id")
def rec_roster(spark, folder):
    """Who plays, found in the first hundred frames only."""
    seen = frames(spark, folder).select("match_id", "frame", F.col("user_id").alias("player_id"), F.expr("CAST(user_id % 2 AS INT)").alias("team"))
    return V.roster(seen, 100)


@query(f"""{FR}, m AS (SELECT DISTINCT match_id, user_id, user_id % 2 AS team FROM fr)
SELECT match_id, count(*) AS n_frames, max(t) AS seconds, (SELECT coalesce(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)), '') FROM m WHERE m.match_id = fr.match_id AND team = 0) AS team0,
  (SELECT coalesce(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)), '') FROM m WHERE m.match_id = fr.match_id AND team = 1) AS team1 FROM fr GROUP BY match_id""")
def rec_match_row(spark, folder):
    fr = frames(spark, folder)
    return V.match_row(fr, V.roster(recordings.players(fr), None))


@query("""WITH m AS (SELECT DISTINCT user_id AS player_id, 'p' || (user_id // 2) AS name FROM events), s AS (SELECT CASE WHEN user_id % 3 = 0 THEN user_id END AS id, 'p' || (user_id // 2) AS name, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE user_id % 3 < 2 GROUP BY user_id),
u AS (SELECT name, any_value(n) AS n, any_value(cents) AS cents FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT m.player_id, m.name, coalesce(s.n, u.n) AS n, coalesce(s.cents, u.cents) AS cents, s.id IS NOT NULL AS by_id FROM m LEFT JOIN s ON s.id = m.player_id LEFT JOIN u ON u.name = m.name""")
def rec_header_stats(spark, folder):
    fr = frames(spark, folder).withColumn("name", F.expr("'p' || CAST(user_id div 2 AS STRING)"))
    stats = fr.where("user_id % 3 < 2").groupBy("user_id", "name").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).withColumn("id", F.when(F.col("user_id") % 3 == 0, F.col("user_id")))
    return V.header_stats(fr.select(F.col("user_id").alias("player_id"), "name").distinct(), stats.drop("user_id"), ["n", "cents"])


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'tournament' WHEN user_id % 7 > 4 THEN 'custom' WHEN event_type = 'purchase' THEN 'ranked' WHEN user_id % 5 > 0 THEN 'casual_' || CAST(CAST(ceil((user_id % 5) / 2) AS BIGINT) AS VARCHAR) || 'v' || CAST(CAST(floor((user_id % 5) / 2) AS BIGINT) AS VARCHAR) ELSE 'unknown' END AS game_type,
CASE WHEN epoch_us(ts) < 1577836800000000 THEN NULL WHEN epoch_us(ts) < 1704067200000000 THEN 'first' WHEN epoch_us(ts) < 1705276800000000 THEN 'second' ELSE 'third' END AS season FROM events""")
def rec_game_type(spark, folder):
    from kairoframe.sources.tables import event_samples

    e = event_samples(spark, folder)
    kind = V.game_type(F.when(F.col("event_type") == "signup", "tournament"), F.col("event_type") == "purchase", F.col("user_id") % 5, F.greatest(F.lit(0), F.col("user_id") % 7 - 4))
    return e.select("event_id", kind.alias("game_type"), V.season(F.col("us"), [(1577836800000000, "first"), (1704067200000000, "second"), (1705276800000000, "third")]).alias("season"))


@query(f"{FR}, a AS (SELECT *, k % 6 AS actor FROM fr) SELECT match_id, frame, actor, last_value(CASE WHEN event_type = 'view' THEN user_id END IGNORE NULLS) OVER (PARTITION BY match_id, actor ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_player FROM a")
def rec_actor_mapping(spark, folder):
    """Which player an actor was mapped to when something happened to it; views remap."""
    rows = frames(spark, folder).select("match_id", "frame", "t", (F.col("k") % 6).alias("actor"), "event_type", F.col("user_id").alias("player"))
    return V.mapped(rows.select("match_id", "frame", "t", "actor"), rows.where("event_type = 'view'"), "actor", "player").select("match_id", "frame", "actor", "last_player")


@query(f"{FR} SELECT match_id, frame, k % 4 AS hit_team FROM fr WHERE k % 4 IN (0, 1)")
def rec_team_touch(spark, folder):
    return V.team_touches(frames(spark, folder).select("match_id", "frame", (F.col("k") % 4).alias("hit_team")))


@query(f"""{FR}, c AS (SELECT match_id, user_id, frame, sum(CASE WHEN event_type = 'view' THEN k % 3 ELSE 0 END) OVER (PARTITION BY match_id, user_id ORDER BY frame) AS v FROM fr), d AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY match_id, user_id ORDER BY frame), 0) AS b FROM c)
SELECT match_id, user_id, frame, CAST(unnest(generate_series(CAST(b AS BIGINT) + 1, CAST(v AS BIGINT))) AS BIGINT) AS number FROM d WHERE v > b""")
def rec_counter_increments(spark, folder):
    rows = frames(spark, folder).select("match_id", "user_id", "frame", F.sum(F.when(F.col("event_type") == "view", F.col("k") % 3).otherwise(0)).over(temporal.running(["match_id", "user_id"], ["frame"])).alias("v"))
    return D.increments(rows, ["match_id", "user_id"], ["frame"], "v", True).select("match_id", "user_id", "frame", "number")


@query(f"""{FR}, s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, user_id ORDER BY frame) AS life, CASE WHEN event_type = 'view' THEN cents END AS v FROM fr)
SELECT match_id, user_id, frame, last_value(v IGNORE NULLS) OVER (PARTITION BY match_id, user_id, life ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM s""")
def rec_sticky(spark, folder):
    rows = frames(spark, folder).select("match_id", "user_id", "frame", F.when(F.col("event_type") == "view", F.col("cents")).alias("v"), (F.col("event_type") == "error").alias("deleted"))
    return D.sticky(rows, ["match_id", "user_id"], ["frame"], "v").select("match_id", "user_id", "frame", "v")


@query(f"""{FR}, p AS (SELECT match_id, frame, t, k % 9 AS pad_id, k % 2 AS sequence, lag(t) OVER (PARTITION BY match_id, k % 9, k % 2 ORDER BY frame) AS l FROM fr WHERE event_type IN ('click', 'error')) SELECT match_id, frame, pad_id, sequence FROM p WHERE l IS NULL OR t - l >= 4""")
def rec_pad_pickups(spark, folder):
    rows = frames(spark, folder).where("event_type IN ('click', 'error')").select("match_id", "frame", "t", (F.col("k") % 9).alias("pad_id"), (F.col("k") % 2).alias("sequence"))
    return V.pad_pickups(rows).select("match_id", "frame", "pad_id", "sequence")


@query(f"""{PL}, s AS (SELECT *, CASE WHEN (frame + player_id) % 19 = 0 THEN boost END AS raw, (frame + player_id) % 3 > 0 AS active, (frame + player_id) % 67 = 0 AS ko FROM pl),
q AS (SELECT *, CASE WHEN ko THEN 85 ELSE raw END AS known FROM s), l AS (SELECT *, count(known) OVER ({PW}) AS life FROM q)
SELECT match_id, player_id, frame, round(greatest(0, coalesce(first_value(known) OVER w, 85) - sum(CASE WHEN known IS NULL AND active THEN dt ELSE 0 END) OVER w * 86.02), 6) AS amount FROM l WINDOW w AS (PARTITION BY match_id, player_id, life ORDER BY frame)""")
def rec_boost_amount(spark, folder):
    at = F.col("frame") + F.col("player_id")
    rows = players(spark, folder).select("match_id", "player_id", "frame", "dt", F.when(at % 19 == 0, F.col("boost")).alias("raw"), (at % 3 > 0).alias("active"), (at % 67 == 0).alias("kickoff"))
    return V.boost_amounts(rows).select("match_id", "player_id", "frame", F.round("amount", 6).alias("amount"))


@query(f"""{FR}, c AS (SELECT match_id, user_id, frame, CASE WHEN k % 5 > 0 THEN k % 2 END AS ball_cam, CASE WHEN k % 7 > 0 THEN k % 3 END AS zoom FROM fr),
d AS (SELECT *, lag(ball_cam) OVER w AS pb, lag(zoom) OVER w AS pz, row_number() OVER w AS rn FROM c WHERE coalesce(ball_cam, zoom) IS NOT NULL WINDOW w AS (PARTITION BY match_id, user_id ORDER BY frame))
SELECT match_id, user_id, frame, ball_cam, zoom FROM d WHERE rn = 1 OR ball_cam IS DISTINCT FROM pb OR zoom IS DISTINCT FROM pz""")
def rec_camera_toggles(spark, folder):
    rows = frames(spark, folder).select("match_id", "user_id", "frame", F.when(F.col("k") % 5 > 0, F.col("k") % 2).alias("ball_cam"), F.when(F.col("k") % 7 > 0, F.col("k") % 3).alias("zoom"))
    return V.toggles(rows, ["match_id", "user_id"], ["frame"], ["ball_cam", "zoom"])


PADS = [(0, -3072.0, -4096.0, True), (1, 3072.0, -4096.0, True), (2, 0.0, 0.0, False), (3, 0.0, 2816.0, False), (4, -3072.0, 4096.0, True), (5, 3072.0, 4096.0, True), (6, 0.0, -2816.0, False)]


@query(f"""{FR}, s AS (SELECT match_id, k % 9 AS pad_id, ball_x AS x, ball_y AS y FROM fr), l AS (SELECT * FROM (VALUES {', '.join(f'({n}, {x}, {y}, {1000.0 if b else 450.0})' for n, x, y, b in PADS)}) v(n, px, py, r)),
v AS (SELECT match_id, pad_id, arg_min(n, (((px - x) * (px - x) + (py - y) * (py - y)), n)) AS place FROM (SELECT *, row_number() OVER () AS id FROM s) JOIN l ON (px - x) * (px - x) + (py - y) * (py - y) <= r * r GROUP BY id, match_id, pad_id),
c AS (SELECT match_id, pad_id, place, count(*) AS votes FROM v GROUP BY 1, 2, 3)
SELECT match_id, pad_id, CAST(place AS INT) AS place, votes FROM c QUALIFY row_number() OVER (PARTITION BY match_id, pad_id ORDER BY votes DESC, place) = 1""")
def rec_pad_identity(spark, folder):
    rows = frames(spark, folder).select("match_id", (F.col("k") % 9).alias("pad_id"), F.col("ball_x").alias("x"), F.col("ball_y").alias("y"))
    return V.pad_identities(rows, PADS)


# --- features


Q = {"qx": "0.6 * up_z", "qy": "0.0", "qz": "0.8 * up_z", "qw": "sqrt(1 - up_z * up_z)"}
SQL_Q = ", ".join(f"{e} AS {c}" for c, e in Q.items())


def turned(spark, folder):
    """Players with a unit quaternion."""
    up = F.col("up_z")
    return players(spark, folder).withColumns({"qx": up * 0.6, "qy": F.lit(0.0), "qz": up * 0.8, "qw": F.sqrt(1 - up * up)})


QUATERNION = tuple(f"q{c}" for c in "xyzw")


@query(f"""{PL}, q AS (SELECT *, {SQL_Q} FROM pl)
SELECT match_id, frame, player_id, x AS pos_x, y AS pos_y, z AS pos_z, round(atan2((qw * qx - qy * qz) * 2, 1 - (qx * qx + qy * qy) * 2), 6) AS rot_x, round(asin(greatest(-1, least(1, (qx * qz + qw * qy) * 2))), 6) AS rot_y, round(atan2((qw * qz - qx * qy) * 2, 1 - (qy * qy + qz * qz) * 2), 6) AS rot_z, vx AS vel_x, vy AS vel_y, vz AS vel_z FROM q""")
def rec_player_body(spark, folder):
    rows = turned(spark, folder).select("match_id", "frame", "player_id", *V.body_columns("", tuple(F.col(c) for c in QUATERNION)))
    return rows.withColumns({f"rot_{c}": F.round(f"rot_{c}", 6) for c in "xyz"})


@query(f"""{PL}, q AS (SELECT *, {SQL_Q} FROM pl) SELECT match_id, frame, player_id, x AS pos_x, y AS pos_y, z AS pos_z, round(qx, 6) AS qx, CAST(qy AS DOUBLE) AS qy, round(qz, 6) AS qz, round(qw, 6) AS qw FROM q""")
def rec_player_pose(spark, folder):
    rows = turned(spark, folder).select("match_id", "frame", "player_id", *V.body_columns("", tuple(F.col(c) for c in QUATERNION), with_velocity=False))
    return rows.withColumns({f"q{c}": F.round(f"q{c}", 6) for c in "xyzw"})


@query(f"{PL} SELECT match_id, frame, player_id, ball_x - x AS rel_x, ball_y - y AS rel_y, ball_z - z AS rel_z, ball_vx - vx AS rel_vx, ball_vy - vy AS rel_vy, ball_vz - vz AS rel_vz FROM pl JOIN (SELECT match_id, frame, ball_vx, ball_vy, ball_vz FROM fr) USING (match_id, frame)")
def rec_relative_ball(spark, folder):
    fr = frames(spark, folder)
    rows = recordings.players(fr).join(fr.select("match_id", "frame", *(f"ball_{c}" for c in ("x", "y", "z", "vx", "vy", "vz"))), ["match_id", "frame"])
    return rows.select("match_id", "frame", "player_id", *(x.alias(f"rel_{c}") for x, c in zip(C.subtract(M.xyz("ball_"), M.xyz("")), "xyz")), *(x.alias(f"rel_v{c}") for x, c in zip(C.subtract(M.xyz("ball_v"), M.xyz("v")), "xyz")))


@query(f"""{PL} SELECT match_id, frame, player_id, boost, round(boost * 100 / 255, 6) AS boost_percent, (frame % 5) % 2 + 2 * ((frame % 7) % 2) + 4 * ((frame % 11) % 2) AS any_jump FROM pl""")
def rec_boost_and_jump(spark, folder):
    jump = V.any_jump(F.col("frame") % 5, F.col("frame") % 7, F.col("frame") % 11)
    return players(spark, folder).select("match_id", "frame", "player_id", "boost", F.round(C.boost_percent(F.col("boost")), 6).alias("boost_percent"), jump.alias("any_jump"))


@query(f"""{PL}, {SQL_DEMOS}, m AS (SELECT match_id, user_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY CAST(user_id AS VARCHAR)) AS INT) AS slot FROM (SELECT DISTINCT match_id, user_id FROM fr))
SELECT pl.match_id, pl.frame, pl.player_id, coalesce(arg_max(slot, (de.frame, slot)), -1) AS demolished_by FROM pl LEFT JOIN (SELECT de.*, slot FROM de JOIN m ON m.match_id = de.match_id AND m.user_id = attacker) de ON de.match_id = pl.match_id AND victim = player_id AND pl.frame - de.frame BETWEEN 0 AND 29 GROUP BY 1, 2, 3""")
def rec_demolished_by(spark, folder):
    return V.demolished_by(players(spark, folder).select("match_id", "frame", "player_id"), demos(spark, folder), V.roster(players(spark, folder), None))


@query(f"""{PT}, {SQL_PASSES}, {SQL_ONE_TIMERS}, {SQL_BOUNCES}, {SQL_DOUBLE_TAPS}, {SQL_DODGES}, {SQL_VOLLEYS}, {SQL_DEMOS},
u AS (SELECT match_id, frame, player_id, 'touch' AS s FROM tc UNION ALL SELECT match_id, frame, receiver, 'pass' FROM pa UNION ALL SELECT match_id, frame, receiver, 'one_timer' FROM ot UNION ALL SELECT match_id, frame, player_id, 'double_tap' FROM dbl
  UNION ALL SELECT match_id, frame, player_id, 'dodge' FROM dg UNION ALL SELECT match_id, frame, player_id, 'half_volley' FROM hv UNION ALL SELECT match_id, frame, attacker, 'demolition' FROM de UNION ALL SELECT match_id, frame, player_id, 'backboard' FROM bo)
SELECT match_id, frame, player_id, {', '.join(f"CAST(coalesce(bool_or(s = '{s}'), false) AS INT) AS {s}" for s in ('touch', 'pass', 'one_timer', 'double_tap', 'dodge', 'half_volley', 'demolition', 'backboard'))} FROM pl LEFT JOIN u USING (match_id, frame, player_id) GROUP BY 1, 2, 3""")
def rec_indicators(spark, folder):
    """0/1 columns of eight event streams for every frame and player, all from one pass."""
    rec = recordings.Recording.of(spark, folder)
    return V.indicators(rec.players.select("match_id", "frame", "player_id"), {n: make(rec) for n, make in STREAMS.items()})


@query(f"{FR} SELECT match_id, frame, t, ball_x FROM fr WHERE frame % 10 = 0")
def rec_every_nth(spark, folder):
    return frames(spark, folder).where("frame % 10 = 0").select("match_id", "frame", "t", "ball_x")


@query(f"""{PL}, s AS (SELECT *, x * 1.05 AS sx, y AS sy, z * 2 AS sz FROM pl), w AS (SELECT *, sz >= 120 AND (abs(sx) >= 3600 OR (abs(sy) >= 5000 AND abs(sx) > 900)) AS wall, 2044 - sz <= 90 AS ceiling FROM s)
SELECT match_id, frame, player_id, wall, ceiling, wall OR ceiling OR sz <= 20 AS surface FROM w""")
def rec_surfaces(spark, folder):
    wall, ceiling, surface = V.on_surface(F.col("x") * 1.05, F.col("y"), F.col("z") * 2)
    return players(spark, folder).select("match_id", "frame", "player_id", wall.alias("wall"), ceiling.alias("ceiling"), surface.alias("surface"))


@query(f"""{PL}, q AS (SELECT *, {SQL_Q} FROM pl)
SELECT match_id, frame, player_id, round(2 * acos(least(1, abs(qw))), 6) AS turned, round(cos(0.5 * (vx / 1000)), 6) AS axis_w, round(sqrt((x - least(3000, greatest(-3000, x))) ** 2 + (y - 0) ** 2), 6) AS off_line,
  'Ball Third' AS title, 'third' AS short FROM q""")
def rec_functions(spark, folder):
    """Angles between rotations, rotations about an axis, distance to a segment, names of streams."""
    q = tuple(F.col(c) for c in QUATERNION)
    one = tuple(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))
    axis = C.axis_angle((F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("vx") / 1000)
    line = C.segment_distance((F.col("x"), F.col("y")), (F.lit(-3000.0), F.lit(0.0)), (F.lit(3000.0), F.lit(0.0)))
    named = F.lit("ball_third")
    return turned(spark, folder).select("match_id", "frame", "player_id", F.round(C.angle_between(q, one), 6).alias("turned"), F.round(axis[3], 6).alias("axis_w"), F.round(line, 6).alias("off_line"), C.title_case(named).alias("title"), C.without_prefix(named, "ball_").alias("short"))


# --- aggregations, orders, spans


@query(f"""{TO}, c AS (SELECT *, CASE WHEN lag(t) OVER ({TW}) IS NULL OR lag(player_id) OVER ({TW}) <> player_id OR t - lag(t) OVER ({TW}) > 2.5 THEN 1 ELSE 0 END AS new FROM tc), e AS (SELECT *, sum(new) OVER ({TW}) AS ep FROM c),
p AS (SELECT match_id, any_value(player_id) AS player_id, min(t) AS s, max(t) AS e, count(*) AS n FROM e GROUP BY match_id, ep HAVING count(*) >= 2 AND max(t) - min(t) >= 1)
SELECT player_id, round(max(e - s), 6) AS longest, max(n) AS most_touches, arg_max(s, (n, s)) AS best_start, count(*) AS n_plays FROM p GROUP BY 1""")
def rec_longest(spark, folder):
    plays = D.controlled_plays(touches(spark, folder))
    return plays.groupBy("player_id").agg(F.round(F.max(F.col("end") - F.col("start")), 6).alias("longest"), F.max("n_touches").alias("most_touches"), F.max_by("start", F.struct("n_touches", "start")).alias("best_start"), F.count("*").alias("n_plays"))


@query(f"""{PL}, o AS (SELECT match_id, frame, last_value(CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id % 2 AS INT) END IGNORE NULLS) OVER ({MW}) AS holder FROM fr),
s AS (SELECT pl.*, CASE WHEN holder IS NULL THEN 'none' WHEN holder = team THEN 'own' ELSE 'other' END AS possession, coalesce(sqrt((x - lag(x) OVER ({PW})) ** 2 + (y - lag(y) OVER ({PW})) ** 2 + (z - lag(z) OVER ({PW})) ** 2), 0) AS step FROM pl JOIN o USING (match_id, frame))
SELECT match_id, player_id, possession, round(sum(step), 3) AS distance, count(*) AS n_samples FROM s GROUP BY 1, 2, 3""")
def rec_distance_by_possession(spark, folder):
    fr = frames(spark, folder)
    touched = F.when(F.col("event_type").isin("click", "view"), F.expr("CAST(user_id % 2 AS INT)"))
    holder = fr.select("match_id", "frame", F.last(touched, ignorenulls=True).over(temporal.running(M.MATCH, ["frame"])).alias("holder"))
    rows = recordings.players(fr).join(holder, ["match_id", "frame"])
    rows = rows.withColumn("possession", F.when(F.col("holder").isNull(), "none").when(F.col("holder") == F.col("team"), "own").otherwise("other"))
    return M.travel_by_state(rows, M.PLAYER, ["frame"], "possession").withColumn("distance", F.round("distance", 3))


@query(f"{FR} SELECT match_id, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM fr GROUP BY 1, 2")
def rec_overlay(spark, folder):
    """Committed sums of the first 200 frames with the pending ones laid over."""
    fr = frames(spark, folder).withColumn("n", F.lit(1).cast("long"))
    committed = fr.where("frame <= 200").groupBy("match_id", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    return M.overlaid(committed, fr.where("frame > 200"), ["match_id", "event_type"], ["n", "cents"])


@query(f"{FR} SELECT match_id, event_type, arg_max(cents, frame) AS cents, max(frame) AS frame FROM fr GROUP BY 1, 2")
def rec_late_joiner(spark, folder):
    fr = frames(spark, folder)
    keys = ["match_id", "event_type"]
    return M.caught_up(clips.snapshot(fr, keys, ["frame"], "frame", "cents", 150).drop("frame").join(fr.where("frame < 150").groupBy(*keys).agg(F.max("frame").alias("frame")), keys), fr.where("frame >= 150"), keys, "frame", "cents", 149)


@query(f"""{FR}, b AS (SELECT match_id, max(CASE WHEN NOT (ball_y > 0) THEN frame END) AS f FROM fr GROUP BY 1)
SELECT fr.match_id, CAST(sum((frame > coalesce(f, 0))::INT) AS BIGINT) AS n, min(CASE WHEN frame > coalesce(f, 0) THEN frame END) AS since FROM fr JOIN b USING (match_id) GROUP BY 1""")
def rec_trailing_run(spark, folder):
    return M.trailing_run(frames(spark, folder), M.MATCH, ["frame"], F.col("ball_y") > 0)


@query(f"""{FR}, {spans_sql('fr', 'match_id', SQL_HALF)}, h AS (SELECT match_id, state, "start" AS s, "end" AS e FROM sp WHERE state IS NOT NULL), r AS (SELECT *, max(e) OVER (PARTITION BY match_id, state ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, state ORDER BY s, e) AS part FROM r)
SELECT match_id, state, min(s) AS "start", max(e) AS "end", count(*) AS n_parts FROM g GROUP BY match_id, state, part""")
def rec_merged_spans(spark, folder):
    halves = D.ball_half(frames(spark, folder)).where("state IS NOT NULL").select("match_id", "state", "start", "end")
    return M.merged_spans(halves, ["match_id", "state"], 2.0)


@query(f"""{FR}, {SQL_GOALS}, {spans_sql('fr', 'match_id', SQL_THIRD)}, h AS (SELECT match_id, state, "start" AS s, "end" AS e FROM sp WHERE state IS NOT NULL)
SELECT go.match_id, go.frame, arg_max(h.state, s) AS session_state FROM go LEFT JOIN h ON h.match_id = go.match_id AND go.t - s BETWEEN 0 AND 100 AND go.t <= e GROUP BY 1, 2""")
def rec_goal_session(spark, folder):
    fr = frames(spark, folder)
    sessions = D.ball_third(fr).where("state IS NOT NULL").select("match_id", "state", "start", "end")
    return M.covered_by(recordings.goals(fr).select("match_id", "frame", "t"), sessions, M.MATCH, 100.0, ["state"]).select("match_id", "frame", "session_state")


# --- folds, clips and sinks


@query(f"""WITH RECURSIVE {SQL_FRAMES}, c AS (SELECT match_id, frame, event_id, CASE WHEN event_type = 'click' THEN 'arm' WHEN event_type = 'purchase' THEN 'confirm' WHEN event_type = 'error' THEN 'reset' ELSE 'other' END AS what, row_number() OVER ({MW}) AS rn FROM fr),
f AS (SELECT match_id, rn, frame, CASE WHEN what = 'arm' THEN event_id END AS id, CASE WHEN what = 'arm' THEN frame END AS at_f, CAST(NULL AS BIGINT) AS out_id, CAST(NULL AS BIGINT) AS out_at, CAST(NULL AS VARCHAR) AS outcome FROM c WHERE rn = 1
  UNION ALL SELECT c.match_id, c.rn, c.frame,
    CASE WHEN c.what = 'arm' THEN c.event_id WHEN c.what IN ('confirm', 'reset') OR c.frame - f.at_f > 5 THEN NULL ELSE f.id END, CASE WHEN c.what = 'arm' THEN c.frame WHEN c.what IN ('confirm', 'reset') OR c.frame - f.at_f > 5 THEN NULL ELSE f.at_f END,
    CASE WHEN f.id IS NOT NULL AND (c.frame - f.at_f > 5 OR c.what IN ('arm', 'confirm', 'reset')) THEN f.id END, CASE WHEN f.id IS NOT NULL THEN CASE WHEN c.frame - f.at_f > 5 THEN f.at_f + 5 WHEN c.what IN ('arm', 'confirm', 'reset') THEN c.frame END END,
    CASE WHEN f.id IS NOT NULL THEN CASE WHEN c.frame - f.at_f > 5 THEN 'expired' WHEN c.what = 'arm' THEN 'replaced' WHEN c.what = 'confirm' THEN 'confirmed' WHEN c.what = 'reset' THEN 'dropped' END END
  FROM f JOIN c ON c.match_id = f.match_id AND c.rn = f.rn + 1)
SELECT match_id, out_id AS armed, out_at AS ended, outcome FROM f WHERE out_id IS NOT NULL
UNION ALL SELECT match_id, id, at_f, 'open' FROM f WHERE id IS NOT NULL AND rn = (SELECT max(rn) FROM c WHERE c.match_id = f.match_id)""")
def rec_in_flight(spark, folder):
    what = F.when(F.col("event_type") == "click", "arm").when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reset").otherwise("other")
    rows = frames(spark, folder).select("match_id", "frame", "event_id", what.alias("what"))
    step, finish = folds.in_flight(5)
    return folds.ordered_fold(rows, M.MATCH, ["frame", "event_id"], ["what"], lambda: None, step, finish, "match_id long, armed long, ended long, outcome string")


@query(f"{FR} SELECT match_id, frame, ball_x, frame >= 100 AS in_clip FROM fr WHERE frame BETWEEN 90 AND 120")
def rec_clip(spark, folder):
    return clips.clip(frames(spark, folder), "frame", 100, 120, 10).select("match_id", "frame", "ball_x", "in_clip")


@query(f"{FR} SELECT match_id, user_id, arg_max(cents, frame) AS cents, CAST(100 AS INT) AS frame FROM fr WHERE frame < 100 GROUP BY 1, 2")
def rec_key_frame(spark, folder):
    return clips.snapshot(frames(spark, folder), ["match_id", "user_id"], ["frame"], "frame", "cents", 100)


@query(f"""{TO} SELECT match_id, player_id, to_json({{'core': {{'touches': count(*), 'first': min(frame)}}, 'position': {{'highest': max(frame)}}}}) AS document FROM tc GROUP BY 1, 2""")
def rec_stats_snapshot(spark, folder):
    """Statistics as one JSON document a player, keyed by module."""
    rows = touches(spark, folder).groupBy("match_id", "player_id").agg(F.struct(F.count("*").alias("touches"), F.min("frame").alias("first")).alias("core"), F.struct(F.max("frame").alias("highest")).alias("position"))
    return sinks.as_json(rows, ["match_id", "player_id"])


@query(f"{FR}, {SQL_GOALS} SELECT match_id, frame, CAST(sum((event_type = 'click')::INT) OVER w AS BIGINT) AS clicks, CAST(sum((event_type = 'view')::INT) OVER w AS BIGINT) AS views, CAST(sum(goal::INT) OVER w AS BIGINT) AS goals FROM fr WINDOW w AS ({MW})")
def rec_full_snapshot(spark, folder):
    """Every frame with the cumulative statistics up to it."""
    w = temporal.running(M.MATCH, ["frame"])
    counts = {"clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view", "goals": F.col("goal")}
    return frames(spark, folder).select("match_id", "frame", *(F.sum(c.cast("long")).over(w).alias(n) for n, c in counts.items()))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def rec_typed_timeline(spark, folder):
    """Events parsed from their JSON with a schema; fields that are not there are null."""
    from kairoframe.sources.tables import table

    parsed = F.from_json("props", "k long, missing string")
    return table(spark, folder, "events").select("event_id", "event_type", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


@query(f"""{FR}, {SQL_GOALS} SELECT match_id, to_json(list({{'from': frame - 30, 'to': frame + 10}} ORDER BY frame)) AS clips FROM go GROUP BY 1""")
def rec_clip_list(spark, folder):
    """The clips of a match's goals as one JSON list."""
    rows = goals(spark, folder).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct((F.col("frame") - 30).alias("from"), (F.col("frame") + 10).alias("to")))).alias("clips"))
    return rows.select("match_id", F.to_json("clips").alias("clips"))


@query(f"""{TO}, {SQL_PASSES}, {SQL_ONE_TIMERS} SELECT match_id, frame, t, 'touch' AS stream, player_id FROM tc UNION ALL SELECT match_id, frame, t, 'pass', receiver FROM pa UNION ALL SELECT match_id, frame, t, 'one_timer', receiver FROM ot""")
def rec_timeline(spark, folder):
    """Streams in one chronological table."""
    fr = frames(spark, folder)
    tc = recordings.touches(fr)
    parts = [tc.select("match_id", "frame", "t", F.lit("touch").alias("stream"), "player_id")]
    for name, events in (("pass", D.passes(tc)), ("one_timer", D.one_timers(tc, fr))):
        parts.append(events.select("match_id", "frame", "t", F.lit(name).alias("stream"), F.col("receiver").alias("player_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("match_id", "t", "stream", "player_id")
