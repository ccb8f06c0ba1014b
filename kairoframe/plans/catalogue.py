"""Every query of the library by name, with the SQL that DuckDB can check it with: the operators bound to events, orders, lineitem and embeddings.

Sums are of integers (cents, micros), and ratios are rounded once at the end, so that results do not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import features, folds, labels, matching, scans, temporal, timeline
from kairoframe.plans.registry import ORACLES, QUERIES, query  # noqa: F401  (the catalogue is read from here)
from kairoframe.sources.shared import shared_path
from kairoframe.sources.tables import event_samples, order_samples, table
from kairoframe.streaming import changes, live
from kairoframe.streaming.arrivals import Arrivals

HOUR = 3_600_000_000
DAY = 24 * HOUR
KEYS, ORDER = ["user_id"], ["us", "event_id"]
TYPES = ["click", "error", "purchase", "signup", "view"]

#: Common table expressions of the oracles: the bindings as SQL has them.
E = """e AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 2 AS team FROM events)"""
O = """o AS (
  SELECT o_orderkey AS orderkey, o_custkey AS custkey, epoch_us(o_orderdate) AS us, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""
W = "PARTITION BY user_id ORDER BY us, event_id"
E_NUMBERED = f"{E}, r AS (SELECT *, row_number() OVER ({W}) AS rn FROM e)"


def stop():
    return F.col("event_type") == "error"


def spend_band(value: str = "cents"):
    return C.band(F.col(value), [(2500, "low"), (7500, "middle")], "high")


BAND = "CASE WHEN cents < 2500 THEN 'low' WHEN cents < 7500 THEN 'middle' WHEN cents IS NOT NULL THEN 'high' END"


@query(f"""
WITH {E},
seg AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({W}) AS segment FROM e),
n AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS p, lead(us) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS nx FROM seg),
i AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS island FROM n),
s AS (SELECT user_id, segment, island, min(event_type) AS event_type, CAST(max(coalesce(nx, us)) - min(us) AS BIGINT) AS span, count(*) AS c,
             sum(CAST(cents AS HUGEINT) * (coalesce(nx, us) - us)) AS weighted, sum(coalesce(nx, us) - us) AS weight FROM i GROUP BY 1, 2, 3)
SELECT event_type, count(*) AS n_spans, CAST(sum(span) AS BIGINT) AS total_micros, max(span) AS longest_micros,
       round(CASE WHEN sum(weight) = 0 THEN 0 ELSE CAST(sum(weighted) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) END, 6) AS mean_cents
FROM s GROUP BY 1
""")
def span_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per user, spans of equal event types, cut at stoppages; per type their number, total and longest time, and the time-weighted mean value."""
    rows = temporal.segment(event_samples(spark, folder), KEYS, ORDER, stop())
    keys = [*KEYS, "segment"]
    rows = labels.with_duration(temporal.islands(rows, keys, ORDER, F.col("event_type")), keys, ORDER, "us")
    weighted = F.col("cents").cast("decimal(20,0)") * F.col("dt").cast("decimal(18,0)")
    spans = rows.groupBy(*keys, "island").agg(F.first("state").alias("event_type"), F.sum("dt").alias("span"), F.sum(weighted.cast("decimal(38,0)")).alias("weighted"))
    summed = spans.groupBy("event_type").agg(F.count("*").alias("n_spans"), F.sum("span").alias("total_micros"), F.max("span").alias("longest_micros"), F.sum("weighted").alias("w"))
    return summed.withColumn("mean_cents", F.round(C.safe_ratio(F.col("w").cast("double"), F.col("total_micros").cast("double")), 6)).drop("w")


@query(f"WITH {E} SELECT event_id, coalesce(cents - lag(cents) OVER ({W}), 0) AS d_cents, coalesce(us - lag(us) OVER ({W}), 0) AS d_us FROM e")
def lag_delta(spark, folder):
    return temporal.with_delta(event_samples(spark, folder), KEYS, ORDER, ["cents", "us"]).select("event_id", "d_cents", "d_us")


@query(f"WITH {E}, f AS (SELECT *, cents >= 5000 AS now, lag(cents >= 5000, 1, false) OVER ({W}) AS before FROM e) SELECT event_id, user_id, us FROM f WHERE now AND NOT before")
def rising_edge(spark, folder):
    return temporal.rising_edges(event_samples(spark, folder), KEYS, ORDER, F.col("cents") >= 5000).select("event_id", "user_id", "us")


@query(f"WITH {E}, f AS (SELECT *, lag(event_type) OVER ({W}) AS p FROM e) SELECT event_id, user_id, event_type FROM f WHERE p IS DISTINCT FROM event_type")
def state_change(spark, folder):
    return temporal.state_changes(event_samples(spark, folder), KEYS, ORDER, F.col("event_type")).select("event_id", "user_id", "event_type")


@query(f"WITH {E}, f AS (SELECT *, lag(us) OVER ({W}) AS p FROM e) SELECT event_id, user_id, us FROM f WHERE p IS NULL OR us - p > {6 * HOUR}")
def dedupe_sliding(spark, folder):
    return temporal.sightings_apart(event_samples(spark, folder), KEYS, ORDER, "us", 6 * HOUR).select("event_id", "user_id", "us")


@query(f"""
WITH RECURSIVE {E_NUMBERED},
f AS (
  SELECT user_id, rn, event_id, us, us AS kept, true AS keep FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn, r.event_id, r.us, CASE WHEN r.us - f.kept >= {12 * HOUR} THEN r.us ELSE f.kept END, r.us - f.kept >= {12 * HOUR}
  FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
SELECT user_id, us, event_id FROM f WHERE keep
""")
def rate_limit(spark, folder):
    return scans.scanned(event_samples(spark, folder), KEYS, ORDER, [], scans.rate_limit(12 * HOUR), "user_id long, us long, event_id long")


@query(f"""
WITH {E}, n AS (SELECT *, lag(event_type) OVER ({W}) AS p, lead(us) OVER ({W}) AS nx FROM e),
i AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER ({W}) AS island FROM n)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS state, min(us) AS "start", max(coalesce(nx, us)) AS "end", count(*) AS n_samples FROM i GROUP BY 1, 2
""")
def islands(spark, folder):
    return temporal.spans(event_samples(spark, folder), KEYS, ORDER, "us", F.col("event_type"))


@query(f"""
WITH {E}, b AS (SELECT *, {BAND} AS band FROM e), n AS (SELECT *, lag(band) OVER ({W}) AS p, lead(us) OVER ({W}) AS nx FROM b),
i AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM band THEN 1 ELSE 0 END) OVER ({W}) AS island FROM n)
SELECT user_id, CAST(island AS BIGINT) AS island, min(band) AS state, min(us) AS "start", max(coalesce(nx, us)) AS "end", count(*) AS n_samples FROM i GROUP BY 1, 2
""")
def islands_bands(spark, folder):
    return temporal.spans(event_samples(spark, folder), KEYS, ORDER, "us", spend_band())


@query(f"""
WITH {E}, s AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({W}) AS BIGINT) AS segment FROM e)
SELECT user_id, segment, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(us) - min(us) AS lasted FROM s GROUP BY 1, 2
""")
def segments_reset(spark, folder):
    rows = temporal.segment(event_samples(spark, folder), KEYS, ORDER, stop())
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), (F.max("us") - F.min("us")).alias("lasted"))


@query(f"""
WITH {E}, p AS (SELECT *, lag(cents) OVER ({W}) AS a, cents AS b FROM e), q AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CAST(least(a, b) >= 2500 AS INT) + CAST(least(a, b) >= 7500 AS INT) AS r0,
         CAST(greatest(a, b) >= 2500 AS INT) + CAST(greatest(a, b) >= 7500 AS INT) AS r1 FROM p WHERE a IS NOT NULL),
x AS (SELECT *, unnest(range(r0, r1 + 1)) AS region FROM q)
SELECT event_id, CAST(region AS INT) AS region, round(CASE WHEN lo = hi THEN 1.0 ELSE
  (CAST(least(hi, CASE region WHEN 0 THEN 2500 WHEN 1 THEN 7500 ELSE hi END) AS DOUBLE) - greatest(lo, CASE region WHEN 0 THEN lo WHEN 1 THEN 2500 ELSE 7500 END)) / (hi - lo) END, 6) AS share
FROM x
""")
def threshold_segments(spark, folder):
    rows = temporal.crossings(event_samples(spark, folder), KEYS, ORDER, "cents", [2500, 7500])
    return rows.select("event_id", F.col("region").cast("int").alias("region"), F.round("share", 6).alias("share"))


@query(f"""
WITH RECURSIVE {E_NUMBERED}, b AS (SELECT *, {BAND} AS band FROM r),
f AS (
  SELECT user_id, rn, us, event_id, band AS holding, CAST(NULL AS VARCHAR) AS rival, CAST(NULL AS BIGINT) AS since FROM b WHERE rn = 1
  UNION ALL
  SELECT b.user_id, b.rn, b.us, b.event_id,
    CASE WHEN b.band = f.holding THEN f.holding WHEN b.band IS DISTINCT FROM f.rival THEN f.holding WHEN b.us - f.since >= {10 * HOUR} THEN b.band ELSE f.holding END,
    CASE WHEN b.band = f.holding THEN NULL WHEN b.band IS DISTINCT FROM f.rival THEN b.band WHEN b.us - f.since >= {10 * HOUR} THEN NULL ELSE f.rival END,
    CASE WHEN b.band = f.holding THEN NULL WHEN b.band IS DISTINCT FROM f.rival THEN b.us WHEN b.us - f.since >= {10 * HOUR} THEN NULL ELSE f.since END
  FROM f JOIN b ON b.user_id = f.user_id AND b.rn = f.rn + 1)
SELECT user_id, us, event_id, holding FROM f
""")
def debounce(spark, folder):
    rows = event_samples(spark, folder).withColumn("band", spend_band())
    return scans.scanned(rows, KEYS, ORDER, ["band"], scans.debounce(10 * HOUR), "user_id long, us long, event_id long, holding string")


@query(f"""
WITH RECURSIVE {E_NUMBERED},
f AS (
  SELECT user_id, rn, us, event_id, CASE WHEN cents < 2000 THEN us END AS entered FROM r WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.rn, r.us, r.event_id,
    CASE WHEN f.entered IS NOT NULL AND (r.cents > 6000 OR r.us - f.entered > {48 * HOUR}) THEN NULL WHEN f.entered IS NULL AND r.cents < 2000 THEN r.us ELSE f.entered END
  FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
SELECT user_id, us, event_id, CAST(entered IS NOT NULL AS INT) AS inside FROM f
""")
def hysteresis(spark, folder):
    return scans.scanned(event_samples(spark, folder), KEYS, ORDER, ["cents"], scans.hysteresis(2000, 6000, 48 * HOUR), "user_id long, us long, event_id long, inside int")


@query(f"""
WITH RECURSIVE {E_NUMBERED}, p AS (SELECT *, cents < 5000 AS pressing FROM r),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS n,
         CAST(NULL AS BIGINT) AS out_start, CAST(NULL AS BIGINT) AS out_end, CAST(NULL AS BIGINT) AS out_n FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL
  SELECT user_id, rn,
    CASE WHEN start2 IS NOT NULL THEN since2 WHEN pressing THEN coalesce(since2, us) END,
    CASE WHEN start2 IS NOT NULL THEN start2 WHEN pressing AND us - coalesce(since2, us) >= {6 * HOUR} THEN coalesce(since2, us) END,
    CASE WHEN start2 IS NOT NULL THEN CASE WHEN pressing THEN us ELSE last2 END WHEN pressing AND us - coalesce(since2, us) >= {6 * HOUR} THEN us END,
    CASE WHEN start2 IS NOT NULL THEN n2 + CAST(pressing AS BIGINT) WHEN pressing THEN CASE WHEN since2 IS NULL THEN 1 ELSE n2 + 1 END ELSE 0 END,
    CASE WHEN ends THEN start END, CASE WHEN ends THEN last END, CASE WHEN ends THEN n END
  FROM (SELECT p.user_id, p.rn, p.us, p.pressing, f.start, f.last, f.n, coalesce(f.start IS NOT NULL AND p.us - f.last >= {18 * HOUR}, false) AS ends,
               CASE WHEN f.start IS NOT NULL AND p.us - f.last >= {18 * HOUR} THEN NULL ELSE f.since END AS since2,
               CASE WHEN f.start IS NOT NULL AND p.us - f.last >= {18 * HOUR} THEN NULL ELSE f.start END AS start2,
               CASE WHEN f.start IS NOT NULL AND p.us - f.last >= {18 * HOUR} THEN NULL ELSE f.last END AS last2,
               CASE WHEN f.start IS NOT NULL AND p.us - f.last >= {18 * HOUR} THEN 0 ELSE f.n END AS n2
        FROM f JOIN p ON p.user_id = f.user_id AND p.rn = f.rn + 1))
SELECT user_id, out_start AS start_us, out_end AS end_us, out_n AS n FROM f WHERE out_start IS NOT NULL
UNION ALL
SELECT user_id, start, last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS z FROM f) WHERE z = 1 AND start IS NOT NULL
""")
def pressure_sessions(spark, folder):
    rows = event_samples(spark, folder).withColumn("pressing", (F.col("cents") < 5000).cast("int"))
    step, finish = folds.sessions(6 * HOUR, 18 * HOUR)
    return folds.ordered_fold(rows, KEYS, ORDER, ["pressing"], lambda: (None, None, None, 0), step, finish, "user_id long, start_us long, end_us long, n long")


@query(f"""
WITH RECURSIVE {E_NUMBERED},
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS rival,
         CAST(NULL AS BIGINT) AS at_us, CAST([] AS STRUCT(owner VARCHAR, start BIGINT, "end" BIGINT, n BIGINT)[]) AS emitted FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL
  SELECT user_id, rn,
    CASE WHEN who = owner2 THEN owner2 WHEN rival2 = who THEN who ELSE owner2 END,
    CASE WHEN who = owner2 THEN start WHEN rival2 = who THEN at_us ELSE start END,
    CASE WHEN who = owner2 THEN us WHEN rival2 = who THEN us ELSE last END,
    CASE WHEN who = owner2 THEN n + 1 WHEN rival2 = who THEN 2 ELSE n END,
    CASE WHEN who = owner2 OR rival2 = who THEN NULL ELSE who END,
    CASE WHEN who = owner2 OR rival2 = who THEN NULL ELSE us END,
    list_concat(CASE WHEN expires THEN [{{'owner': owner, 'start': start, 'end': last, 'n': n}}] ELSE [] END,
                CASE WHEN rival2 = who AND owner2 IS NOT NULL AND owner2 <> who THEN [{{'owner': owner2, 'start': start, 'end': last, 'n': n}}] ELSE [] END)
  FROM (SELECT r.user_id, r.rn, r.us, r.event_type AS who, f.owner, f.start, f.last, f.n, f.at_us,
               coalesce(f.owner IS NOT NULL AND r.us - f.last > {30 * HOUR}, false) AS expires,
               CASE WHEN f.owner IS NOT NULL AND r.us - f.last > {30 * HOUR} THEN NULL ELSE f.owner END AS owner2,
               CASE WHEN f.rival IS NOT NULL AND r.us - f.at_us > {30 * HOUR} THEN NULL ELSE f.rival END AS rival2
        FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)),
done AS (
  SELECT user_id, unnest(emitted) AS x FROM f
  UNION ALL
  SELECT user_id, {{'owner': owner, 'start': start, 'end': last, 'n': n}} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS z FROM f) WHERE z = 1 AND owner IS NOT NULL)
SELECT user_id, x.owner AS owner, x.start AS start_us, x."end" AS end_us, x.n AS touches FROM done
""")
def possession_resolver(spark, folder):
    step, finish = folds.possession(30 * HOUR)
    return folds.ordered_fold(event_samples(spark, folder), KEYS, ORDER, ["event_type"], lambda: (None, None, None, 0, None, None), step, finish, "user_id long, owner string, start_us long, end_us long, touches long")


@query(f"""
WITH {E}, c AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'purchase')
SELECT c.event_id, count(e.cents) AS n_samples, min(e.cents) AS low, max(e.cents) AS high FROM c JOIN e ON e.user_id = c.user_id AND e.us BETWEEN c.us AND c.us + {8 * HOUR} GROUP BY 1
""")
def candidate_window(spark, folder):
    rows = event_samples(spark, folder)
    found = temporal.window_extremes(rows.where("event_type = 'purchase'").select("event_id", "user_id", "us"), rows, KEYS, "us", 8 * HOUR, "cents")
    return found.select("event_id", "n_samples", "low", "high")


@query(f"""
WITH {E} SELECT event_id, count(*) OVER w AS n_recent, CAST(sum(cents) OVER w AS BIGINT) AS recent_cents, max(cents) OVER w AS recent_max
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)
""")
def rolling_history(spark, folder):
    rows = temporal.rolling(event_samples(spark, folder), KEYS, "us", DAY, {"n_recent": F.count("*"), "recent_cents": F.sum("cents"), "recent_max": F.max("cents")})
    return rows.select("event_id", "n_recent", "recent_cents", "recent_max")


@query(f"""
WITH {E}, d AS (SELECT *, coalesce(lead(us) OVER ({W}) - us, 0) AS dt FROM e), x AS (
  SELECT event_id, event_type, CAST(sum(CASE WHEN cents < 2500 THEN dt ELSE 0 END) OVER w AS BIGINT) AS low_us, CAST(sum(CASE WHEN cents >= 7500 THEN dt ELSE 0 END) OVER w AS BIGINT) AS high_us
  FROM d WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN high_us > low_us THEN 'attack' WHEN low_us > high_us THEN 'defence' ELSE 'even' END AS zone FROM x WHERE event_type = 'purchase'
""")
def lookback_zone(spark, folder):
    rows = labels.with_duration(event_samples(spark, folder), KEYS, ORDER, "us")
    rows = temporal.rolling(rows, KEYS, "us", 2 * DAY, {"low_us": F.sum(F.when(F.col("cents") < 2500, F.col("dt")).otherwise(0)), "high_us": F.sum(F.when(F.col("cents") >= 7500, F.col("dt")).otherwise(0))})
    zone = F.when(F.col("high_us") > F.col("low_us"), "attack").when(F.col("low_us") > F.col("high_us"), "defence").otherwise("even")
    return rows.where("event_type = 'purchase'").select("event_id", zone.alias("zone"))


@query(f"""
WITH {E} SELECT a.event_id, EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.us > a.us AND b.us <= a.us + {4 * HOUR}) AS led_to_purchase
FROM e a WHERE a.event_type = 'click'
""")
def retro_tag(spark, folder):
    rows = event_samples(spark, folder)
    tagged = temporal.tag_before(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), KEYS, "us", "event_id", 4 * HOUR, "led_to_purchase")
    return tagged.select("event_id", "led_to_purchase")


@query(f"""
WITH {O}, x AS (SELECT *, count(*) OVER w AS members, max(cents) OVER w - min(cents) OVER w AS spread, row_number() OVER (PARTITION BY custkey ORDER BY cents, orderkey) AS up,
  row_number() OVER (PARTITION BY custkey ORDER BY cents DESC, orderkey DESC) AS down FROM o WINDOW w AS (PARTITION BY custkey))
SELECT orderkey, CASE WHEN members = 1 THEN 'alone' WHEN spread < 1000000 THEN 'other' WHEN up = 1 THEN 'back' WHEN down = 1 THEN 'front' ELSE 'other' END AS role FROM x
""")
def group_roles(spark, folder):
    return temporal.roles(order_samples(spark, folder), ["custkey"], "cents", "orderkey", 1_000_000).select("orderkey", "role")


@query(f"WITH {O} SELECT custkey, count(*) AS members, max(cents) - min(cents) AS spread, max(cents) - min(cents) < 10000000 AS together FROM o GROUP BY 1")
def group_spread(spark, folder):
    grouped = order_samples(spark, folder).groupBy("custkey").agg(F.count("*").alias("members"), (F.max("cents") - F.min("cents")).alias("spread"))
    return grouped.withColumn("together", F.col("spread") < 10_000_000)


@query(f"""
WITH {E}, x AS (SELECT *, lag(cents) OVER ({W}) AS v1, lag(cents, 2) OVER ({W}) AS v2, lag(us) OVER ({W}) AS t1, lag(us, 2) OVER ({W}) AS t2 FROM e)
SELECT event_id, round(cents - (v1 + CAST(v1 - v2 AS DOUBLE) / CASE WHEN t1 > t2 THEN t1 - t2 END * (us - t1)), 3) AS deviation FROM x
""")
def prediction_deviation(spark, folder):
    return temporal.deviation(event_samples(spark, folder), KEYS, ORDER, "us", "cents").select("event_id", F.round("deviation", 3).alias("deviation"))


@query(f"""
WITH {E}, p AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({W}) AS BIGINT) AS phase FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, phase ORDER BY us, event_id) AS z FROM p WHERE phase > 0 AND event_type = 'purchase')
SELECT user_id, phase, event_id, us FROM n WHERE z = 1
""")
def first_in_phase(spark, folder):
    rows = temporal.first_in_phase(event_samples(spark, folder), KEYS, ORDER, F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return rows.select("user_id", "phase", "event_id", "us")


AS_OF = f"""
WITH {E}, x AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_event_id,
  last_value(CASE WHEN event_type = 'click' THEN us END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_us FROM e)"""


@query(f"{AS_OF} SELECT event_id, coalesce(last_event_id, -1) AS last_event_id FROM x WHERE event_type = 'purchase'")
def asof_last(spark, folder):
    rows = event_samples(spark, folder)
    found = matching.as_of(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), KEYS, "us", "event_id", ["event_id"])
    return found.select("event_id", F.coalesce("last_event_id", F.lit(-1)).alias("last_event_id"))


@query(f"{AS_OF} SELECT event_id, CASE WHEN us - at_us <= {DAY} THEN last_event_id ELSE -1 END AS last_event_id FROM x WHERE event_type = 'purchase'")
def asof_stale(spark, folder):
    rows = event_samples(spark, folder)
    found = matching.as_of(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), KEYS, "us", "event_id", ["event_id"], DAY)
    return found.select("event_id", F.coalesce("last_event_id", F.lit(-1)).alias("last_event_id"))


LATEST = f"""
WITH {E}, x AS (SELECT p.event_id, p.user_id, p.us, c.event_id AS match_event_id, c.us AS match_us, row_number() OVER (PARTITION BY p.event_id ORDER BY c.us DESC, c.event_id DESC) AS z
  FROM e p JOIN e c ON c.user_id = p.user_id AND c.event_type = 'view' AND c.us < p.us AND c.us >= p.us - {DAY} WHERE p.event_type = 'purchase')"""


@query(f"{LATEST} SELECT event_id, match_event_id FROM x WHERE z = 1")
def interval_latest(spark, folder):
    rows = event_samples(spark, folder)
    return matching.latest_before(rows.where("event_type = 'purchase'"), rows.where("event_type = 'view'"), KEYS, "us", "event_id", DAY, ["event_id"]).select("event_id", "match_event_id")


@query(f"""{LATEST} SELECT event_id, match_event_id FROM x WHERE z = 1
AND NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = x.user_id AND b.event_type = 'error' AND b.us > x.match_us AND b.us < x.us)""")
def interval_unbroken(spark, folder):
    rows = event_samples(spark, folder)
    pairs = matching.latest_before(rows.where("event_type = 'purchase'"), rows.where("event_type = 'view'"), KEYS, "us", "event_id", DAY, ["event_id", "us"])
    pairs = pairs.select("user_id", "event_id", "us", "match_event_id", "match_us")
    return matching.unbroken(pairs, rows.where(stop()), KEYS, "match_us", "us", "us").select("event_id", "match_event_id")


PAIRS = f"""
WITH {O}, x AS (SELECT a.custkey, a.orderkey AS a_orderkey, b.orderkey AS b_orderkey, a.us AS a_us, b.us AS b_us FROM o a JOIN o b ON a.custkey = b.custkey
  AND b.us - a.us BETWEEN 0 AND {90 * DAY} AND (b.us > a.us OR b.orderkey > a.orderkey))"""


@query(f"{PAIRS} SELECT custkey, a_orderkey, b_orderkey FROM x")
def pair_self_join(spark, folder):
    return matching.pairs_within(order_samples(spark, folder), ["custkey"], "orderkey", "us", 90 * DAY).select("custkey", "a_orderkey", "b_orderkey")


@query(f"{PAIRS} SELECT custkey, a_orderkey, b_orderkey FROM x WHERE NOT EXISTS (SELECT 1 FROM o f WHERE f.custkey = x.custkey AND f.status = 'F' AND f.orderkey IN (x.a_orderkey, x.b_orderkey))")
def pair_suppressed(spark, folder):
    rows = order_samples(spark, folder)
    pairs = matching.pairs_within(rows, ["custkey"], "orderkey", "us", 90 * DAY).select("custkey", "a_orderkey", "b_orderkey")
    done = rows.where("status = 'F'").select("custkey", "orderkey")
    for side in ("a_orderkey", "b_orderkey"):
        pairs = pairs.join(done.withColumnRenamed("orderkey", side), ["custkey", side], "left_anti")
    return pairs


@query("SELECT c_custkey, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS INT) AS has_pending FROM customer")
def semi_indicator(spark, folder):
    pending = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return matching.flag_exists(table(spark, folder, "customer").select("c_custkey"), pending, ["c_custkey"], "has_pending")


@query(f"""
WITH {O}, a AS (SELECT orderkey, cents AS value_a FROM o), b AS (SELECT l_orderkey AS orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value_b FROM lineitem GROUP BY 1)
SELECT status, count(*) AS n, CAST(sum(coalesce(value_a, 0)) AS BIGINT) AS total_a, CAST(sum(coalesce(value_b, 0)) AS BIGINT) AS total_b FROM (
  SELECT value_a, value_b, CASE WHEN b.orderkey IS NULL THEN 'only_a' WHEN a.orderkey IS NULL THEN 'only_b' WHEN abs(value_a - value_b) <= 5000000 THEN 'both' ELSE 'differs' END AS status
  FROM a FULL JOIN b ON a.orderkey = b.orderkey) GROUP BY 1
""")
def reconcile_outer(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    found = matching.reconcile(order_samples(spark, folder), lines, ["orderkey"], "cents", 5_000_000)
    return found.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("value_a", F.lit(0))).alias("total_a"), F.sum(F.coalesce("value_b", F.lit(0))).alias("total_b"))


@query(f"""
WITH v AS (SELECT vec_id, label, embedding AS x FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT label, list_transform([{', '.join(f'avg(x[{i}])' for i in range(1, 65))}], lambda a: round(a, 6)) AS centre FROM v GROUP BY 1),
d AS (SELECT vec_id, c.label, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(x[i] AS DOUBLE) - centre[i]) * (CAST(x[i] AS DOUBLE) - centre[i]))), 9) AS d FROM v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS z FROM d)
SELECT vec_id, label AS nearest_label, round(d, 6) AS distance2 FROM r WHERE z = 1
""")
def nearest_dimension(spark, folder):
    rows = table(spark, folder, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", F.col("embedding").alias("x"))
    centres = rows.groupBy("label").agg(F.array(*(F.round(F.avg(F.get("x", F.lit(i))), 6) for i in range(64))).alias("centre"))
    return matching.nearest(rows.drop("label"), "x", centres, "label", "centre").select("vec_id", "nearest_label", F.round("distance2", 6).alias("distance2"))


@query(f"""
WITH {E}, {O}, a AS (SELECT CAST(floor(us / {DAY}) AS BIGINT) % 28 AS day, event_type, count(*) AS n_events FROM e GROUP BY 1, 2),
b AS (SELECT CAST(floor(us / {DAY}) AS BIGINT) % 28 AS day, status, count(*) AS n_orders FROM o GROUP BY 1, 2)
SELECT event_type, status, count(*) AS n, CAST(sum(n_events * n_orders) AS BIGINT) AS total FROM a JOIN b USING (day) GROUP BY 1, 2
""")
def crosstab(spark, folder):
    day = (F.floor(F.col("us") / DAY) % 28).alias("day")
    a = event_samples(spark, folder).groupBy(day, "event_type").agg(F.count("*").alias("n_events"))
    b = order_samples(spark, folder).groupBy(day, "status").agg(F.count("*").alias("n_orders"))
    return matching.crosstab(a, b, ["day"], "event_type", "status", F.col("n_events") * F.col("n_orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def label_counts(spark, folder):
    return labels.label_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], F.round(F.col("l_extendedprice") * 100).cast("long"))


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN '*' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN '*' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def label_rollup(spark, folder):
    return labels.roll_up(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
WITH g AS (SELECT * FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(o_orderstatus), (VALUES ('1-URGENT'), ('5-LOW'), ('9-NEVER')) p(o_orderpriority)),
c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (o_orderstatus, o_orderpriority)
""")
def label_complete(spark, folder):
    counts = labels.label_counts(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])
    return labels.completed(counts, {"o_orderstatus": ["F", "O", "P", "X"], "o_orderpriority": ["1-URGENT", "5-LOW", "9-NEVER"]})


DT = f"{E}, d AS (SELECT *, coalesce(lead(us) OVER ({W}) - us, 0) AS dt FROM e)"


@query(f"""
WITH {DT} SELECT user_id, CAST(sum(dt) AS BIGINT) AS duration, round(CASE WHEN sum(dt) = 0 THEN 0 ELSE CAST(sum(CAST(cents AS HUGEINT) * dt) AS DOUBLE) / CAST(sum(dt) AS DOUBLE) END, 6) AS mean FROM d GROUP BY 1
""")
def time_weighted_avg(spark, folder):
    return labels.time_weighted(labels.with_duration(event_samples(spark, folder), KEYS, ORDER, "us"), ["user_id"], "cents", "dt")


@query(f"""
WITH {DT}, b AS (SELECT user_id, {BAND} AS band, CAST(sum(dt) AS BIGINT) AS duration FROM d GROUP BY 1, 2), s AS (SELECT *, sum(duration) OVER (PARTITION BY user_id) AS whole FROM b)
SELECT user_id, band, duration, round(CASE WHEN whole = 0 THEN 0 ELSE duration * 100.0 / CAST(whole AS DOUBLE) END, 6) AS percent FROM s
""")
def band_histogram(spark, folder):
    return labels.band_histogram(labels.with_duration(event_samples(spark, folder), KEYS, ORDER, "us"), ["user_id"], spend_band(), "dt")


@query(f"WITH {E}, s AS (SELECT user_id, abs(cents - lag(cents) OVER ({W})) AS d FROM e) SELECT user_id, CAST(coalesce(sum(d), 0) AS BIGINT) AS path, count(*) AS n FROM s GROUP BY 1")
def path_length(spark, folder):
    return labels.path_length(event_samples(spark, folder), KEYS, ORDER, "cents")


@query(f"""
WITH {E}, s AS (SELECT user_id, CAST(sum(cents) AS BIGINT) AS amount, max(us) - min(us) AS observed FROM e GROUP BY 1)
SELECT user_id, amount, observed, round(CASE WHEN observed = 0 THEN 0 ELSE amount * 60000000.0 / CAST(observed AS DOUBLE) END, 6) AS per_minute FROM s
""")
def rate_per_minute(spark, folder):
    return labels.rate_per_minute(event_samples(spark, folder), KEYS, "us", "cents")


@query(f"""
WITH {E}, x AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN us END IGNORE NULLS) OVER w AS last_time, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_so_far
  FROM e WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(last_time, -1) AS last_time, coalesce(us - last_time, -1) AS since_last, n_so_far FROM x
""")
def last_event_fields(spark, folder):
    return labels.last_event_fields(event_samples(spark, folder), KEYS, ORDER, "us", F.col("event_type") == "purchase").select(
        "event_id", F.coalesce("last_time", F.lit(-1)).alias("last_time"), F.coalesce("since_last", F.lit(-1)).alias("since_last"), "n_so_far"
    )


@query(f"""
WITH {E}, s AS (SELECT event_type, CAST(coalesce(sum(cents) FILTER (team = 0), 0) AS BIGINT) AS a, CAST(coalesce(sum(cents) FILTER (team = 1), 0) AS BIGINT) AS b FROM e GROUP BY 1)
SELECT event_type, 0 AS team, a AS own, b AS theirs, a - b AS difference FROM s UNION ALL SELECT event_type, 1, b, a, b - a FROM s
""")
def team_relative(spark, folder):
    return labels.sides(event_samples(spark, folder), ["event_type"], "team", "cents")


@query(f"""
WITH {E} SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS cents_so_far, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS purchases_so_far
FROM e WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_projection(spark, folder):
    rows = labels.projected(event_samples(spark, folder), KEYS, ORDER, {"cents_so_far": F.col("cents"), "purchases_so_far": F.when(F.col("event_type") == "purchase", 1).otherwise(0)})
    return rows.select("event_id", "cents_so_far", "purchases_so_far")


@query(f"""
WITH {E}, x AS (SELECT event_id, k, CAST(sum(CASE WHEN event_type = 'signup' THEN cents ELSE 0 END) OVER w AS BIGINT) AS obtained, CAST(sum(CASE WHEN event_type = 'error' THEN cents ELSE 0 END) OVER w AS BIGINT) AS removed
  FROM e WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, obtained, removed, greatest(0, obtained - removed - k) AS used FROM x
""")
def ledger(spark, folder):
    rows = event_samples(spark, folder)
    found = labels.ledger(rows, KEYS, ORDER, F.when(F.col("event_type") == "signup", F.col("cents")).otherwise(0), F.when(stop(), F.col("cents")).otherwise(0), F.col("k"))
    return found.select("event_id", "obtained", "removed", "used")


@query(f"""
WITH {E}, t AS (SELECT *, CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS track FROM e),
p AS (SELECT *, lag(track) OVER ({W}) AS prev FROM t) SELECT event_id, user_id, track FROM p WHERE prev IS NULL OR track <> prev
""")
def change_points(spark, folder):
    return labels.change_points(event_samples(spark, folder), KEYS, ORDER, F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0)).select("event_id", "user_id", "track")


@query(f"""
WITH {E}, g AS (SELECT user_id, us - lag(us) OVER ({W}) AS gap FROM e), s AS (SELECT user_id, CAST(coalesce(sum(gap), 0) AS BIGINT) AS observed, CAST(coalesce(sum(gap) FILTER (gap > {DAY}), 0) AS BIGINT) AS missing FROM g GROUP BY 1)
SELECT *, missing >= observed * 0.25 AS absent FROM s
""")
def activity_summary(spark, folder):
    return labels.activity(event_samples(spark, folder), KEYS, ORDER, "us", DAY, 0.25)


@query(f"""
WITH {E}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2)
SELECT event_type, count(*) AS entities, CAST(sum(n) AS BIGINT) AS events, max(n) AS most, round(sum(n) / count(*), 6) AS mean FROM c GROUP BY 1
""")
def rate_by_entity(spark, folder):
    return labels.mean_rate(event_samples(spark, folder), KEYS, ["event_type"])


@query(f"""
WITH {O}, r AS (SELECT 'positive_total' AS rule, cents > 0 AS ok FROM o UNION ALL SELECT 'known_status', status IN ('F', 'O') FROM o UNION ALL SELECT 'below_limit', cents < 40000000 FROM o)
SELECT rule, count(*) FILTER (NOT coalesce(ok, false)) AS n_broken FROM r GROUP BY 1
""")
def invariants(spark, folder):
    return labels.violations(order_samples(spark, folder), {"positive_total": F.col("cents") > 0, "known_status": F.col("status").isin("F", "O"), "below_limit": F.col("cents") < 40_000_000})


@query(f"WITH {O} SELECT priority, CAST(median(cents) AS DOUBLE) AS median, round(avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share FROM o GROUP BY 1")
def median_fraction(spark, folder):
    return labels.median_and_share(order_samples(spark, folder), ["priority"], "cents", F.col("status") == "F")


@query(f"""
WITH {E}, a AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0 FROM e), b AS (SELECT *, (us - t0) // {36 * HOUR} AS num FROM a),
c AS (SELECT *, coalesce(lag(num) OVER ({W}), -1) AS before FROM b), x AS (SELECT *, unnest(range(before + 1, num + 1)) AS point FROM c WHERE num > before)
SELECT user_id, t0 + point * {36 * HOUR} AS grid, event_id FROM x
""")
def downsample_grid(spark, folder):
    return features.on_grid(event_samples(spark, folder), KEYS, ORDER, "us", 36 * HOUR).select("user_id", "grid", "event_id")


@query(f"""
WITH {E}, a AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id)) // {36 * HOUR} AS num FROM e), c AS (SELECT *, lag(num) OVER ({W}) AS before, lead(us) OVER ({W}) AS nx FROM a)
SELECT event_id, user_id, us FROM c WHERE before IS NULL OR num > before OR nx IS NULL
""")
def step_persist(spark, folder):
    return features.one_per_step(event_samples(spark, folder), KEYS, ORDER, "us", 36 * HOUR).select("event_id", "user_id", "us")


@query(f"""
WITH {E}, v AS (SELECT *, CASE WHEN event_type <> 'error' THEN cents END AS v, CASE WHEN event_type <> 'error' THEN us END AS t FROM e),
x AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(t IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(t IGNORE NULLS) OVER f AS t1 FROM v
  WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN CAST(v AS DOUBLE) WHEN t1 > t0 THEN v0 + (v1 - v0) * ((us - t0) / CAST(t1 - t0 AS DOUBLE)) WHEN t1 = t0 THEN CAST(v0 AS DOUBLE) END, 4) AS filled FROM x
""")
def interpolate(spark, folder):
    rows = features.interpolated(event_samples(spark, folder), KEYS, ORDER, "us", F.when(~stop(), F.col("cents")), "filled")
    return rows.select("event_id", F.round("filled", 4).alias("filled"))


REGISTRY = features.Registry()


@REGISTRY.feature("amount")
def _amount():
    return [("amount", F.col("cents"))]


@REGISTRY.feature("moment")
def _moment():
    return [("day", F.floor(F.col("us") / DAY)), ("second", F.floor(F.col("us") / 1_000_000) % 86_400)]


@REGISTRY.feature("kind")
def _kind():
    return [(f"is_{t}", (F.col("event_type") == t).cast("int")) for t in TYPES]


@query(f"""
WITH {E} SELECT CAST(us // {DAY} AS BIGINT) AS day, {', '.join(f"coalesce(max(cents) FILTER (event_type = '{t}'), 0) AS {t}_amount, coalesce(max((us // 1000000) % 86400) FILTER (event_type = '{t}'), 0) AS {t}_second" for t in TYPES)}
FROM e GROUP BY 1
""")
def feature_matrix(spark, folder):
    rows = REGISTRY.select(event_samples(spark, folder), ["event_type"], ["amount", "moment"])
    return features.wide(rows, ["day"], "event_type", TYPES, ["amount", "second"])


# --- functions of columns, streams and change logs


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").where("embedding IS NOT NULL")


V = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d, CAST(embedding[5] AS DOUBLE) AS e, CAST(embedding[6] AS DOUBLE) AS f FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"""
WITH {V} SELECT vec_id, round(a * d + b * e + c * f, 6) AS dot, round(sqrt(a * a + b * b + c * c), 6) AS length, round(b * f - c * e, 6) AS cross_x,
  round(CASE WHEN a * a + b * b + c * c > 0 THEN a / sqrt(a * a + b * b + c * c) ELSE 0 END, 6) AS unit_x, round(a + (d - a) * 0.25, 6) AS lerp_x FROM v
""")
def vec_ops(spark, folder):
    p, q = C.vector("embedding", 0), C.vector("embedding", 3)
    return _vectors(spark, folder).select(
        "vec_id",
        F.round(C.dot(p, q), 6).alias("dot"),
        F.round(C.length(p), 6).alias("length"),
        F.round(C.cross(p, q)[0], 6).alias("cross_x"),
        F.round(C.normalised(p)[0], 6).alias("unit_x"),
        F.round(C.lerp(p, q, 0.25)[0], 6).alias("lerp_x"),
    )


@query(f"""
WITH {V}, n AS (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS z FROM v), q AS (SELECT vec_id, a / z AS x, b / z AS y, c / z AS w3, d / z AS w, e, f FROM n WHERE z > 0),
t AS (SELECT *, 2 * (y * 1.0 - w3 * f) AS tx, 2 * (w3 * e - x * 1.0) AS ty, 2 * (x * f - y * e) AS tz FROM q)
SELECT vec_id, round(e + w * tx + (y * tz - w3 * ty), 6) AS rx, round(f + w * ty + (w3 * tx - x * tz), 6) AS ry, round(1.0 + w * tz + (x * ty - y * tx), 6) AS rz FROM t
""")
def quat_rotate(spark, folder):
    rows = _vectors(spark, folder).withColumn("z", C.length(C.vector("embedding", 0, 4))).where("z > 0")
    q = C.scale(C.vector("embedding", 0, 4), F.lit(1.0))
    unit = tuple(x / F.col("z") for x in q)
    turned = C.rotate(unit, (*C.vector("embedding", 4, 2), F.lit(1.0)))
    return rows.select("vec_id", *(F.round(x, 6).alias(n) for x, n in zip(turned, ("rx", "ry", "rz"))))


@query(f"WITH {E} SELECT event_id, round(greatest(0.0, least(1.0, (cents - 1000) / 9000.0)), 6) AS score FROM e")
def norm_score(spark, folder):
    return event_samples(spark, folder).select("event_id", F.round(C.unit_score(F.col("cents"), 1000.0, 10_000.0), 6).alias("score"))


STREAMS = f"""WITH {E}, s AS (SELECT 'sale' AS stream, user_id, us, event_id, cents, CAST(NULL AS BIGINT) AS k FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT 'fault', user_id, us, event_id, NULL, k FROM e WHERE event_type = 'error')"""


def _streams(spark, folder):
    rows = event_samples(spark, folder)
    return timeline.union_streams({
        "sale": rows.where("event_type = 'purchase'").select("user_id", "us", "event_id", "cents"),
        "fault": rows.where(stop()).select("user_id", "us", "event_id", "k"),
    })


@query(f"{STREAMS} SELECT stream, user_id, us, event_id, coalesce(cents, -1) AS cents, coalesce(k, -1) AS k FROM s")
def timeline_union(spark, folder):
    return _streams(spark, folder).select("stream", "user_id", "us", "event_id", F.coalesce("cents", F.lit(-1)).alias("cents"), F.coalesce("k", F.lit(-1)).alias("k"))


@query(f"""{STREAMS}, d AS (SELECT *, us // {DAY} AS day FROM s)
SELECT event_id, stream || ':' || CAST(day AS VARCHAR) || ':' || CAST(row_number() OVER (PARTITION BY user_id, stream, day ORDER BY us, event_id) - 1 AS VARCHAR) AS event_key FROM d""")
def event_ids(spark, folder):
    rows = _streams(spark, folder).withColumn("day", F.floor(F.col("us") / DAY))
    return timeline.with_event_ids(rows, KEYS, "stream", "day", ORDER).select("event_id", "event_key")


@query(f"""
WITH {E}, a AS (SELECT event_id, cents, event_type FROM e WHERE k < 60), b AS (SELECT event_id, CASE WHEN event_type = 'click' THEN cents + 1 ELSE cents END AS cents, event_type FROM e WHERE k >= 20)
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'retract' ELSE 'upsert' END AS change, coalesce(b.cents, -1) AS cents, b.event_type
FROM a FULL JOIN b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.cents IS DISTINCT FROM b.cents OR a.event_type IS DISTINCT FROM b.event_type
""")
def changelog_diff(spark, folder):
    rows = event_samples(spark, folder)
    changed = rows.where("k >= 20").withColumn("cents", F.when(F.col("event_type") == "click", F.col("cents") + 1).otherwise(F.col("cents")))
    return timeline.changes(rows.where("k < 60"), changed, ["event_id"], ["cents", "event_type"]).withColumn("cents", F.coalesce("cents", F.lit(-1)))


@query(f"""
WITH {E}, p AS (SELECT *, lag(event_type) OVER ({W}) AS pt, lag(us) OVER ({W}) AS pu FROM e),
c AS (SELECT *, CAST(sum(CASE WHEN pu IS NULL OR pt IS DISTINCT FROM event_type OR us - pu > {DAY} THEN 1 ELSE 0 END) OVER ({W}) AS BIGINT) AS episode FROM p)
SELECT user_id, episode, min(event_type) AS event_type, count(*) AS n, max(us) - min(us) AS lasted FROM c GROUP BY 1, 2 HAVING count(*) >= 2
""")
def chain_episodes(spark, folder):
    rows = temporal.chains(event_samples(spark, folder), KEYS, ORDER, "us", "event_type", DAY)
    found = rows.groupBy("user_id", "episode").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("lasted"))
    return found.where("n >= 2")


@query("""
WITH p AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS from_role FROM conversations)
SELECT from_role, role AS to_role, count(*) AS n FROM p WHERE from_role IS NOT NULL AND role IS DISTINCT FROM from_role GROUP BY 1, 2
""")
def pass_pairs(spark, folder):
    rows = temporal.with_previous(table(spark, folder, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], ["role"])
    return rows.where("prev_role IS NOT NULL AND role <> prev_role").groupBy(F.col("prev_role").alias("from_role"), F.col("role").alias("to_role")).agg(F.count("*").alias("n"))


def _arrivals(spark, folder: str, path: str, parts: int) -> Arrivals:
    """events in the order of time, in that many parts of equal length."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.expr("CAST(ts AS timestamp)").alias("ts"))
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.lit(parts - 1), F.floor((F.unix_micros("ts") - (first or 0)) * parts / max(1, (last or 0) - (first or 0) + 1)))
    return Arrivals(rows, part, parts, path)


@query(ORACLES["rate_limit"])
def live_replay_equivalence(spark, folder):
    """rate_limit as a stream: events arrive in four parts and are folded in keyed state behind a watermark of a day; with what the drained stream
    still held, the result is that of the batch."""
    path = shared_path(spark, "rate-limit")
    arrivals = _arrivals(spark, folder, path, 4)
    step, schema = folds.rate_limit(12 * HOUR), "user_id long, us long, event_id long"
    rows = live.folded_stream(arrivals.stream().withColumn("us", F.unix_micros("ts")), KEYS, ORDER, [], "ts", "1 day", lambda: None, step, folds.nothing, schema)
    arrivals.run(lambda: live.drained(rows, path))
    emitted = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    return emitted.unionByName(live.flushed(spark, f"{path}/progress", KEYS, ORDER, step, folds.nothing, schema))


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, user_id, n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS INT) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3
""")
def live_changelog(spark, folder):
    """The three busiest users of each event type, projected anew with every micro-batch and published as upserts and retractions; the log, drained in two steps from a stored
    cursor and replayed, gives the final table."""
    path = shared_path(spark, "changelog")
    arrivals = _arrivals(spark, folder, path, 4)
    counts = arrivals.stream().groupBy("event_type", "user_id").agg(F.count("*").alias("n"))

    def project(batch: DataFrame, number: int) -> None:
        top = temporal.ranked(batch, ["event_type"], [F.desc("n"), F.col("user_id")], "rank").where("rank <= 3")
        live.publish(top, number, path, ["event_type", "user_id"], ["n", "rank"])

    stream = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/progress").foreachBatch(project).trigger(availableNow=True)
    arrivals.run(lambda: stream.start().awaitTermination())
    log = spark.read.parquet(f"{path}/changes").drop("number")
    for until in (2, None):
        changes.drain(spark, f"{path}/changes", log.schema, f"{path}/cursor", f"{path}/drained", until)
    return live.replayed(spark.read.schema(log.schema).parquet(f"{path}/drained"), ["event_type", "user_id"])


@query(f"""
WITH {E}, c AS (SELECT user_id, event_id, us % 1000 AS clock FROM e), p AS (SELECT *, lag(clock) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM c),
s AS (SELECT *, CAST(sum(CASE WHEN clock < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session FROM p)
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2
""")
def clock_resets(spark, folder):
    """Sessions of each source in the order of arrival: a clock that goes backwards begins a new match."""
    rows = event_samples(spark, folder).select("user_id", "event_id", (F.col("us") % 1000).alias("clock"))
    rows = rows.withColumn("before", F.lag("clock").over(temporal.ordered(KEYS, ["event_id"])))
    cut = temporal.segment(rows, KEYS, ["event_id"], F.col("clock") < F.col("before"), "session")
    return cut.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


from kairoframe.plans import lifecycle, possession, recording  # noqa: E402, F401  (add their own queries)
