"""Raw changes of a recording -> rosters, headers and discrete events.

Everything is partitioned by match (and player or pad), so that chains of these cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import matching, temporal

# Fixed values of the game's rules.
PAD_REPEAT, BOOST_PER_SECOND, BOOST_START, BOOST_MOST = 4.0, 86.02, 85.0, 255.0
SMALL_RADIUS, BIG_RADIUS = 450.0, 1000.0
WALL_Z, SIDE_WALL_X, BACK_WALL_Y, GOAL_MOUTH_X, CEILING_Z, CEILING_GAP = 120.0, 3600.0, 5000.0, 900.0, 2044.0, 90.0
MATCH = ["match_id"]


# --- who plays, and what is known of a match


def roster(players: DataFrame, first_frames: int | None = 300) -> DataFrame:
    """match_id, player_id, team, slot: the players seen in a match's first frames (None: in any frame), numbered per match by the text of their ids."""
    seen = (players if first_frames is None else players.where(F.col("frame") <= first_frames)).groupBy("match_id", "player_id").agg(F.min("team").alias("team"))
    return temporal.ranked(seen, MATCH, [F.col("player_id").cast("string")], "slot")


def match_row(frames: DataFrame, members: DataFrame) -> DataFrame:
    """One row per match: its frames and seconds, and the names of either team in order."""
    sizes = frames.groupBy("match_id").agg(F.count("*").alias("n_frames"), F.max("t").alias("seconds"))
    names = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("team") == i, F.col("player_id").cast("string")))), ",").alias(f"team{i}") for i in (0, 1)]
    return sizes.join(members.groupBy("match_id").agg(*names), "match_id")


def header_stats(members: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Members (player_id, name) with the stats of their id (stats: id, name, columns) or, where there are none, of their name, if one row has it."""
    by_id = stats.where("id IS NOT NULL").select(F.col("id").alias("player_id"), F.struct(*columns).alias("of_id"))
    by_name = stats.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct(*columns)).alias("of_name")).where("n = 1").drop("n")
    joined = members.join(by_id, "player_id", "left").join(by_name, "name", "left")
    return joined.select(*members.columns, *(F.coalesce(F.col(f"of_id.{c}"), F.col(f"of_name.{c}")).alias(c) for c in columns), F.col("of_id").isNotNull().alias("by_id"))


def game_type(declared: Column, ranked: Column, n_players: Column, mutators: Column) -> Column:
    """What is declared; else what the network's signals say; else what the number of players allows."""
    guess = F.when(mutators > 0, "custom").when(ranked, "ranked").when(n_players > 0, F.concat(F.lit("casual_"), F.ceil(n_players / 2).cast("string"), F.lit("v"), F.floor(n_players / 2).cast("string")))
    return F.coalesce(declared, guess, F.lit("unknown"))


def season(clock: Column, starts: list[tuple[int, str]]) -> Column:
    """The name of the last season that began by then; null before the first. starts are in order."""
    return F.when(clock >= starts[0][0], C.band(clock, [(later, name) for (_, name), (later, _) in zip(starts, starts[1:])], starts[-1][1]))


def mapped(events: DataFrame, mappings: DataFrame, key: str, value: str) -> DataFrame:
    """Events with the value (as last_<value>) that their key was last mapped to; mappings are change rows (match_id, frame, key, value)."""
    return matching.as_of(events, mappings, ["match_id", key], "t", "frame", [value])


# --- replicated values -> events


def team_touches(changes: DataFrame) -> DataFrame:
    """One event for every update of the hit-team value to 0 or 1."""
    return changes.where(F.col("hit_team").isin(0, 1))


def toggles(samples: DataFrame, keys: list[str], order: list[str], flags: list[str]) -> DataFrame:
    """The samples at which any of the flags differs from the last sample that had one; samples without any flag are passed over."""
    known = samples.where(F.coalesce(*flags).isNotNull())
    return temporal.state_changes(known, keys, order, F.struct(*flags))


def goal_scorers(goals: DataFrame, exploders: DataFrame, counters: DataFrame) -> DataFrame:
    """goals(match_id, frame, team, ...) with ``scorer``: the player of the scoring team named by the explosion of that frame; else one whose goal
    counter rises in it (the smallest id); and which of them it was. exploders, counters: match_id, frame, team, player_id."""
    keys = ["match_id", "frame", "team"]
    named = [df.groupBy(*keys).agg(F.min("player_id").alias(c)) for df, c in ((exploders, "exploder"), (counters, "counted"))]
    joined = goals.join(named[0], keys, "left").join(named[1], keys, "left")
    source = F.when(F.col("exploder").isNotNull(), "explosion").when(F.col("counted").isNotNull(), "counter").otherwise("none")
    return joined.withColumn("scorer", F.coalesce("exploder", "counted")).withColumn("source", source).drop("exploder", "counted")


def pad_pickups(reports: DataFrame) -> DataFrame:
    """reports(match_id, pad_id, sequence, t, frame, ...) without those replayed: the same pad and sequence less than 4 s after the last sighting."""
    w = temporal.ordered(["match_id", "pad_id", "sequence"], ["t", "frame"])
    return reports.withColumn("__last", F.lag("t").over(w)).where(F.col("__last").isNull() | (F.col("t") - F.col("__last") >= PAD_REPEAT)).drop("__last")


def boost_amounts(samples: DataFrame) -> DataFrame:
    """samples(match_id, player_id, frame, dt, raw, active, kickoff) with ``amount``: the raw value where one is known, a kickoff's start value, else
    the last amount less what active boosting used since, not below 0. Since use only lowers an amount between two resets, the floor is that of
    the whole difference."""
    keys = ["match_id", "player_id"]
    known = F.when(F.col("kickoff"), F.lit(BOOST_START)).otherwise(F.col("raw"))
    cut = temporal.segment(samples.withColumn("__known", known), keys, ["frame"], known.isNotNull(), "__life")
    w = temporal.running([*keys, "__life"], ["frame"])
    used = F.sum(F.when(F.col("__known").isNull() & F.col("active"), F.col("dt")).otherwise(0.0)).over(w) * BOOST_PER_SECOND
    start = F.coalesce(F.first("__known").over(w), F.lit(BOOST_START))
    return cut.withColumn("amount", F.greatest(F.lit(0.0), start - used)).drop("__known", "__life")


def pad_identities(sightings: DataFrame, layout: list[tuple[int, float, float, bool]]) -> DataFrame:
    """match_id, pad_id, place, votes: the place of a known layout (number, x, y, big) that most sightings of a pad (match_id, pad_id, x, y) are
    nearest to, within its radius; ties go to the smaller number."""
    places = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(BIG_RADIUS if big else SMALL_RADIUS).alias("r")) for n, x, y, big in layout))
    square = lambda p: (p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y"))
    near = F.transform(F.filter(places, lambda p: square(p) <= p["r"] * p["r"]), lambda p: F.struct(square(p).alias("d"), p["n"].alias("n")))
    voted = sightings.withColumn("place", F.array_min(near)["n"]).where("place IS NOT NULL").groupBy("match_id", "pad_id", "place").agg(F.count("*").alias("votes"))
    return temporal.ranked(voted, ["match_id", "pad_id"], [F.desc("votes"), F.col("place")], "__n").where("__n = 1").drop("__n")


# --- feature columns of samples


def body_columns(p: str, q: C.Vector, with_velocity: bool = True) -> list[Column]:
    """Position, Euler angles and velocity of a body whose columns begin with ``p``; or position and quaternion."""
    place = [F.col(f"{p}{c}").alias(f"{p}pos_{c}") for c in "xyz"]
    if not with_velocity:
        return place + [x.alias(f"{p}q{c}") for x, c in zip(q, "xyzw")]
    return place + [x.alias(f"{p}rot_{c}") for x, c in zip(C.euler_xyz(q), "xyz")] + [F.col(f"{p}v{c}").alias(f"{p}vel_{c}") for c in "xyz"]


def any_jump(dodge: Column, jump: Column, double: Column) -> Column:
    """Component bytes are active if odd: a bit mask of dodge 1, jump 2, double jump 4."""
    return (dodge % 2) + F.shiftleft(jump % 2, 1) + F.shiftleft(double % 2, 2)


def demolished_by(players: DataFrame, demolitions: DataFrame, members: DataFrame, frames: int = 30) -> DataFrame:
    """players with ``demolished_by``: the slot of who demolished them less than ``frames`` frames ago, or -1."""
    named = demolitions.join(members.select("match_id", F.col("player_id").alias("attacker"), F.col("slot").alias("attacker_slot")), ["match_id", "attacker"])
    hits = matching.in_window(named.select("match_id", F.col("victim").alias("player_id"), F.col("frame").alias("at"), "attacker_slot"), players.select("match_id", "player_id", "frame"), ["match_id", "player_id"], "at", "frame", 0, frames - 1)
    last = hits.groupBy("match_id", "player_id", "frame").agg(F.max_by("attacker_slot", F.struct("at", "attacker_slot")).alias("demolished_by"))
    return players.join(last, ["match_id", "player_id", "frame"], "left").withColumn("demolished_by", F.coalesce("demolished_by", F.lit(-1)))


def indicators(players: DataFrame, streams: dict[str, DataFrame]) -> DataFrame:
    """players with a 0/1 column for every stream (match_id, frame, player_id) that has an event of the player in the frame. The streams are united and
    pivoted first, so that any number of them costs one join."""
    united = None
    for name, events in streams.items():
        rows = events.select("match_id", "frame", "player_id", F.lit(name).alias("__stream"))
        united = rows if united is None else united.unionByName(rows)
    keys = ["match_id", "frame", "player_id"]
    wide = united.groupBy(*keys).agg(*(F.max((F.col("__stream") == n).cast("int")).alias(n) for n in streams))
    return players.join(wide, keys, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in streams})


def on_surface(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Whether a car is on a side or back wall, on the ceiling, or touches any surface."""
    wall = (z >= WALL_Z) & ((F.abs(x) >= SIDE_WALL_X) | ((F.abs(y) >= BACK_WALL_Y) & (F.abs(x) > GOAL_MOUTH_X)))
    ceiling = F.lit(CEILING_Z) - z <= CEILING_GAP
    return wall, ceiling, wall | ceiling | (z <= 20)
