"""The live generator of events on recordings (streaming/generator.py), with SQL that derives its whole log from the final data; a sweep over files of recordings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.operators import temporal
from kairoframe.plans.recording import DEMOLISHED, FR, SQL_DEMOS, VICTIM
from kairoframe.plans.registry import query
from kairoframe.sources import recordings, sweep
from kairoframe.sources.shared import shared_path
from kairoframe.streaming import generator, live
from kairoframe.streaming.arrivals import Arrivals

PARTS, JITTER = 3, 1500
#: Matches of so many milliseconds in all share a key of the generator's state.
KEY_MS = 2_000_000


def matches_a_key(longest: int) -> int:
    """How many matches of up to ``longest`` milliseconds share a key."""
    return max(1, min(generator.TOGETHER, KEY_MS // max(longest, 1)))


def live_rows(frames: DataFrame) -> DataFrame:
    """match_id, ms, kind, a, b: sightings of demolitions, counters of purchases at each player's actions, and each recording's end; all from one pass over the frames."""
    shots = F.sum((F.col("event_type") == "purchase").cast("long")).over(temporal.running(["match_id", "user_id"], ["frame"]))
    last = F.lead("frame").over(temporal.ordered(["match_id"], ["frame"])).isNull()
    ms = F.col("frame") * 100
    seen = frames.select("match_id", ms.alias("ms"), "user_id", F.expr(DEMOLISHED).alias("demolished"), F.expr(VICTIM).alias("victim"), shots.alias("shots"), last.alias("last"))

    def row(kind: str, ms: Column, a: Column, b: Column) -> Column:
        return F.struct(ms.alias("ms"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    none = F.lit(0).cast("long")
    demolition, counter, end = row("demolition", F.col("ms"), F.col("user_id"), F.col("victim")), row("counter", F.col("ms"), F.col("user_id"), F.col("shots")), row("end", F.col("ms") + 100, none, none)
    return seen.select("match_id", F.inline(F.array_compact(F.array(F.when(F.col("demolished"), demolition), counter, F.when(F.col("last"), end)))))


def live_log(spark, folder) -> DataFrame:
    """The generator's log of rows that come up to 1.5 s late, in parts and out of order; one more part, without rows of any match, moves the clock past them all."""
    path = shared_path(spark, "lifecycle")
    frames = recordings.frames(spark, folder)
    rows = live_rows(frames)
    longest = frames.agg(F.max("frame") * 100 + 100).first()[0] or 0  # the last end
    late = F.col("ms") + F.pmod(F.xxhash64("match_id", "ms", "kind", "a", "b"), F.lit(JITTER))
    part = F.least(F.lit(PARTS - 1), F.floor(late * PARTS / (longest + JITTER)))
    past = spark.range(1).select(F.lit(-1).cast("long").alias("match_id"), F.lit(longest + 60_000).cast("long").alias("ms"), F.lit("end").alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    staged = rows.withColumn("part", part.cast("int")).unionByName(past.withColumn("part", F.lit(PARTS)))
    arrivals = Arrivals(staged.withColumn("ts", F.timestamp_millis("ms")), F.col("part"), PARTS + 1, path)
    with generator.state_in_rocksdb(spark):
        log = generator.generated(arrivals.stream().drop("part"), "2 seconds", matches_a_key(longest))
        arrivals.run(lambda: live.drained(log, path))
    return spark.read.schema(generator.LOG).parquet(f"{path}/rows")


SQL_LOG = f"""{FR}, {SQL_DEMOS},
en AS (SELECT match_id, max(frame) * 100 + 100 AS stop FROM fr GROUP BY match_id),
si0 AS (SELECT match_id, frame * 100 AS ms, attacker, victim, lag(frame * 100) OVER (PARTITION BY match_id, attacker, victim ORDER BY frame) AS before FROM de),
si AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, attacker, victim ORDER BY ms) AS num FROM si0),
ep AS (SELECT match_id, attacker, victim, num, min(ms) AS first_ms, max(ms) AS last_ms FROM si GROUP BY ALL),
tk AS (SELECT DISTINCT match_id, attacker, victim, num, (ms + 999) // 1000 * 1000 AS tick FROM si UNION SELECT match_id, attacker, victim, num, ((last_ms + 800) // 1000 + 1) * 1000 FROM ep),
pb AS (SELECT DISTINCT match_id, attacker, victim, num, least(tick, stop) AS at_ms, tick >= stop AS done FROM tk JOIN en USING (match_id)),
lg AS (SELECT p.match_id, at_ms, CASE WHEN bool_or(done) OR at_ms - max(ms) > 800 THEN 'finalized' ELSE 'confirmed' END AS lifecycle, 'demolition' AS stream, 'demolition:' || p.attacker || ':' || p.victim || ':' || min(ms) AS event_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n
  FROM pb p JOIN si s ON s.match_id = p.match_id AND s.attacker = p.attacker AND s.victim = p.victim AND s.num = p.num AND s.ms <= p.at_ms GROUP BY p.match_id, p.attacker, p.victim, p.num, at_ms),
ct0 AS (SELECT match_id, frame * 100 AS ms, user_id, sum((event_type = 'purchase')::BIGINT) OVER (PARTITION BY match_id, user_id ORDER BY frame) AS v FROM fr),
ct AS (SELECT *, lag(v) OVER (PARTITION BY match_id, user_id ORDER BY ms) AS before FROM ct0),
al AS (SELECT * FROM lg UNION ALL SELECT match_id, least((ms + 999) // 1000 * 1000, stop), 'finalized', 'increment', 'increment:' || user_id || ':' || CAST(v AS BIGINT), ms, ms, 1 FROM ct JOIN en USING (match_id) WHERE v > before),
tl AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY at_ms, event_id) - 1 AS seq, at_ms, lifecycle, stream, event_id, start_ms, end_ms, n FROM al)"""


@query(f"{SQL_LOG} SELECT * FROM tl")
def live_lifecycle(spark, folder):
    """Every transaction of the live log: confirmed events, their revisions, and what is final by its stream's horizon."""
    return live_log(spark, folder)


@query(f"{SQL_LOG} SELECT match_id, stream, event_id, start_ms, end_ms, n, lifecycle FROM tl QUALIFY row_number() OVER (PARTITION BY match_id, event_id ORDER BY seq DESC) = 1")
def live_current(spark, folder):
    """The table that the live log leads to, everything in it final; a promise that the log broke would show as a row of its own."""
    log = live_log(spark, folder)
    broken = generator.violations(log).select("match_id", "event_id", F.col("broken").alias("lifecycle"))
    return generator.current(log).select("match_id", "stream", "event_id", "start_ms", "end_ms", "n", "lifecycle").unionByName(broken, allowMissingColumns=True)


def _goals_of(content: bytes) -> dict:
    """A match's file of one JSON object a line: how many frames, goals, and the last clock."""
    rows = [json.loads(line) for line in content.decode().splitlines()]
    return {"match_id": rows[0]["match_id"], "n_frames": len(rows), "n_goals": sum(r["goal"] for r in rows), "seconds": max(r["t"] for r in rows)}


@query(f"""{FR}, m AS (SELECT match_id, count(*) AS n_frames, CAST(sum(goal::INT) AS BIGINT) AS n_goals, max(t) AS seconds FROM fr GROUP BY match_id)
SELECT match_id, match_id % 5 > 0 AS ok, CASE WHEN match_id % 5 > 0 THEN n_frames END AS n_frames, CASE WHEN match_id % 5 > 0 THEN n_goals END AS n_goals, CASE WHEN match_id % 5 > 0 THEN seconds END AS seconds FROM m""")
def corpus_sweep(spark, folder):
    """Every match as a file of JSON lines, a fifth of them with a broken line: a sweep returns a row for each."""
    path = shared_path(spark, "corpus")
    frames = recordings.frames(spark, folder).select("match_id", "frame", F.to_json(F.struct("match_id", "frame", "t", "goal")).alias("value"))
    broken = (F.col("match_id") % 5 == 0) & (F.col("frame") == 3)
    lines = frames.withColumn("value", F.when(broken, F.substring("value", 1, 9)).otherwise(F.col("value"))).withColumn("file", F.col("match_id"))
    lines.repartition("file").sortWithinPartitions("file", "frame").select("file", "value").write.partitionBy("file").text(path)
    found = sweep.swept(spark, path, "*.txt", _goals_of, "match_id long, n_frames long, n_goals long, seconds double")
    name = F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long")
    return found.select(name.alias("match_id"), "ok", "n_frames", "n_goals", "seconds")
