"""Operators over each entity's samples in order. DataFrame in, DataFrame out.

keys: the entity's columns; order: columns that order its samples totally. All windows of one entity share their partitioning, so that a
chain of these operators costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """prev_<column> of each column."""
    w = ordered(keys, order)
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns))


def with_delta(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """d_<column>: the change since the entity's previous sample, 0 at its first."""
    w = ordered(keys, order)
    return df.select("*", *(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)).alias(f"d_{c}") for c in columns))


def rising_edges(df: DataFrame, keys: list[str], order: list[str], condition: Column) -> DataFrame:
    """The samples at which the condition holds and did not before (before the first: not)."""
    flagged = df.withColumn("__now", F.coalesce(condition, F.lit(False)))
    return flagged.withColumn("__before", F.lag("__now", 1, False).over(ordered(keys, order))).where("__now AND NOT __before").drop("__now", "__before")


def state_changes(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """The samples whose state differs from the previous one's, the first included; nulls equal each other."""
    w = ordered(keys, order)
    staged = df.withColumn("__state", state).withColumn("__first", F.row_number().over(w) == 1).withColumn("__prev", F.lag("__state").over(w))
    return staged.where(F.col("__first") | ~F.col("__state").eqNullSafe(F.col("__prev"))).drop("__state", "__first", "__prev")


def sightings_apart(df: DataFrame, keys: list[str], order: list[str], clock: str, gap: int) -> DataFrame:
    """The samples more than gap after the previous sighting, kept or not (a sliding suppression window)."""
    w = ordered(keys, order)
    return df.withColumn("__prev", F.lag(clock).over(w)).where(F.col("__prev").isNull() | (F.col(clock) - F.col("__prev") > gap)).drop("__prev")


def segment(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "segment") -> DataFrame:
    """Numbers the stretches between samples at which starts holds; add it to the keys to reset an operator there."""
    return df.withColumn(name, F.sum(F.coalesce(starts.cast("long"), F.lit(0))).over(running(keys, order)))


def islands(df: DataFrame, keys: list[str], order: list[str], state: Column, name: str = "island") -> DataFrame:
    """Adds ``state`` and the number of its run of equal states."""
    w = ordered(keys, order)
    staged = df.withColumn("state", state).withColumn("__prev", F.lag("state").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    change = (F.col("__first") | ~F.col("state").eqNullSafe(F.col("__prev"))).cast("long")
    return staged.withColumn("__change", change).withColumn(name, F.sum("__change").over(running(keys, order))).drop("__prev", "__first", "__change")


def spans(df: DataFrame, keys: list[str], order: list[str], clock: str, state: Column) -> DataFrame:
    """One row per run of equal states: from its first sample to the next run's first (the last run: to its last sample)."""
    runs = islands(df, keys, order, state).withColumn("__next", F.lead(clock).over(ordered(keys, order)))
    return runs.groupBy(*keys, "island").agg(
        F.first("state").alias("state"), F.min(clock).alias("start"), F.max(F.coalesce("__next", clock)).alias("end"), F.count("*").alias("n_samples")
    )


def crossings(df: DataFrame, keys: list[str], order: list[str], value: str, thresholds: list[int]) -> DataFrame:
    """Cuts each step from the previous to this value at the thresholds it crosses: a row per region passed (0: below the first
    threshold), with the share of the step spent there. A motion without change stays in its region with share 1."""
    w = ordered(keys, order)
    staged = df.withColumn("from_value", F.lag(value).over(w)).where(F.col("from_value").isNotNull())
    a, b = F.col("from_value"), F.col(value)

    def region(v: Column) -> Column:
        return sum((F.when(v >= t, 1).otherwise(0) for t in thresholds[1:]), F.when(v >= thresholds[0], 1).otherwise(0))

    low, high = F.least(a, b), F.greatest(a, b)
    cut = staged.withColumn("region", F.explode(F.sequence(region(low), region(high))))
    edges = F.array(*(F.lit(t).cast("double") for t in thresholds))
    floor = F.when(F.col("region") == 0, low.cast("double")).otherwise(F.greatest(low.cast("double"), F.get(edges, F.col("region") - 1)))
    ceiling = F.when(F.col("region") == len(thresholds), high.cast("double")).otherwise(F.least(high.cast("double"), F.get(edges, F.col("region"))))
    return cut.withColumn("share", F.when(low == high, 1.0).otherwise((ceiling - floor) / (high - low)))


def window_extremes(candidates: DataFrame, samples: DataFrame, keys: list[str], clock: str, width: int, value: str) -> DataFrame:
    """Each candidate with the number, minimum and maximum of the entity's values from it to ``width`` later, both ends included."""
    from kairoframe.operators.matching import in_window

    rows = in_window(candidates, samples.select(*keys, F.col(clock).alias("sample_clock"), F.col(value).alias("sample_value")), keys, clock, "sample_clock", 0, width)
    return rows.groupBy(*candidates.columns).agg(F.count("sample_value").alias("n_samples"), F.min("sample_value").alias("low"), F.max("sample_value").alias("high"))


def rolling(df: DataFrame, keys: list[str], clock: str, width: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the entity's samples of the last ``width`` of the clock, this moment's included."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(-width, Window.currentRow)
    return df.select("*", *(c.over(w).alias(n) for n, c in aggregates.items()))


def ranked(df: DataFrame, group: list[str], by: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by)))


def roles(df: DataFrame, group: list[str], value: str, tie: str, threshold: int) -> DataFrame:
    """Each member's role in its group: alone, back, front, other; all are other if the group spreads by less than the threshold."""
    w = Window.partitionBy(*group)
    up, down = w.orderBy(value, tie), w.orderBy(F.desc(value), F.desc(tie))
    staged = df.select("*", F.count("*").over(w).alias("members"), (F.max(value).over(w) - F.min(value).over(w)).alias("spread"), F.row_number().over(up).alias("__up"), F.row_number().over(down).alias("__down"))
    role = F.when(F.col("members") == 1, "alone").when(F.col("spread") < threshold, "other").when(F.col("__up") == 1, "back").when(F.col("__down") == 1, "front").otherwise("other")
    return staged.withColumn("role", role).drop("__up", "__down")


def deviation(df: DataFrame, keys: list[str], order: list[str], clock: str, value: str) -> DataFrame:
    """The difference between a value and what the two samples before predict by constant velocity (null before the third sample)."""
    w = ordered(keys, order)
    v1, v2, t1, t2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lag(clock, 1).over(w), F.lag(clock, 2).over(w)
    staged = df.select("*", v1.alias("__v1"), v2.alias("__v2"), t1.alias("__t1"), t2.alias("__t2"))
    slope = (F.col("__v1") - F.col("__v2")) / F.when(F.col("__t1") > F.col("__t2"), F.col("__t1") - F.col("__t2"))
    predicted = F.col("__v1") + slope * (F.col(clock) - F.col("__t1"))
    return staged.withColumn("deviation", F.col(value) - predicted).drop("__v1", "__v2", "__t1", "__t2")


def first_in_phase(df: DataFrame, keys: list[str], order: list[str], starts: Column, wanted: Column) -> DataFrame:
    """The first wanted sample of each phase (a phase begins at starts; samples before the first start have none)."""
    phased = segment(df, keys, order, starts, "phase").where(F.col("phase") > 0).where(wanted)
    return ranked(phased, [*keys, "phase"], [F.col(c) for c in order], "__n").where("__n = 1").drop("__n")


def tag_before(df: DataFrame, later: DataFrame, keys: list[str], clock: str, tie: str, width: int, name: str) -> DataFrame:
    """Adds whether one of the later rows follows within ``width`` (not at the same moment)."""
    from kairoframe.operators.matching import in_window

    hits = in_window(df.select(*keys, clock, tie), later.select(*keys, F.col(clock).alias("__later")), keys, clock, "__later", 1, width).select(*keys, tie).distinct()
    return df.join(hits.withColumn(name, F.lit(True)), [*keys, tie], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def chains(df: DataFrame, keys: list[str], order: list[str], clock: str, same: str, gap: int) -> DataFrame:
    """Episodes: consecutive samples of one key with equal ``same`` no more than gap apart."""
    w = ordered(keys, order)
    staged = df.withColumn("__p", F.lag(same).over(w)).withColumn("__t", F.lag(clock).over(w))
    new = F.col("__t").isNull() | ~F.col(same).eqNullSafe(F.col("__p")) | (F.col(clock) - F.col("__t") > gap)
    return staged.withColumn("__new", new.cast("long")).withColumn("episode", F.sum("__new").over(running(keys, order))).drop("__p", "__t", "__new")
