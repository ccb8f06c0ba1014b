"""Label-keyed counts and sums, and time-weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.functions.columns import safe_ratio
from kairoframe.operators.temporal import ordered, running


def label_counts(df: DataFrame, labels: list[str], weight: Column | None = None) -> DataFrame:
    """Rows, and the weights' sum, per set of labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"), *([F.sum(weight).alias("total")] if weight is not None else []))


def roll_up(df: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of every subset of the labels; a label that a row leaves open is ``*``. Combined before the shuffle."""
    cube = df.cube(*labels).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"__{c}") for c in labels))
    return cube.select(*(F.when(F.col(f"__{c}") == 1, "*").otherwise(F.col(c)).alias(c) for c in labels), "n")


def completed(counts: DataFrame, domains: dict[str, list], value: str = "n") -> DataFrame:
    """Counts with a zero for each combination of the domains' values that is missing. The domains are short lists in the code."""
    grid = counts.sparkSession.range(1)
    for name, values in domains.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.drop("id").join(counts, list(domains), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def with_duration(df: DataFrame, keys: list[str], order: list[str], clock: str, name: str = "dt") -> DataFrame:
    """The time until the entity's next sample; 0 at its last."""
    return df.withColumn(name, F.coalesce(F.lead(clock).over(ordered(keys, order)) - F.col(clock), F.lit(0)))


def time_weighted(df: DataFrame, by: list[str], value: str, duration: str) -> DataFrame:
    """Duration, duration x value, and their ratio, per group."""
    exact = (F.col(value).cast("decimal(20,0)") * F.col(duration).cast("decimal(18,0)")).cast("decimal(38,0)")
    summed = df.groupBy(*by).agg(F.sum(duration).alias("duration"), F.sum(exact).alias("__weighted"))
    return summed.withColumn("mean", F.round(safe_ratio(F.col("__weighted").cast("double"), F.col("duration").cast("double")), 6)).drop("__weighted")


def band_histogram(df: DataFrame, by: list[str], bands: Column, duration: str) -> DataFrame:
    """Time in each band and its share of the group's time."""
    summed = df.withColumn("band", bands).groupBy(*by, "band").agg(F.sum(duration).alias("duration"))
    whole = F.sum("duration").over(Window.partitionBy(*by))
    return summed.withColumn("percent", F.round(safe_ratio(F.col("duration") * 100.0, whole.cast("double")), 6))


def path_length(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    step = F.abs(F.col(value) - F.lag(value).over(ordered(keys, order)))
    return df.withColumn("__step", step).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0)).alias("path"), F.count("*").alias("n"))


def rate_per_minute(df: DataFrame, keys: list[str], clock: str, amount: str) -> DataFrame:
    """The amount per minute of the entity's observed time (micros); 0 without any."""
    summed = df.groupBy(*keys).agg(F.sum(amount).alias("amount"), (F.max(clock) - F.min(clock)).alias("observed"))
    return summed.withColumn("per_minute", F.round(safe_ratio(F.col("amount") * 60e6, F.col("observed").cast("double")), 6))


def last_event_fields(df: DataFrame, keys: list[str], order: list[str], clock: str, condition: Column) -> DataFrame:
    """At every sample: when the condition last held (this sample included), the time since, and how often it has held."""
    w = running(keys, order)
    staged = df.withColumn("last_time", F.last(F.when(condition, F.col(clock)), ignorenulls=True).over(w))
    return staged.withColumn("since_last", F.col(clock) - F.col("last_time")).withColumn("n_so_far", F.sum(F.when(condition, 1).otherwise(0)).over(w))


def sides(df: DataFrame, by: list[str], team: str, amount: str) -> DataFrame:
    """Two teams' totals as seen by each: own, theirs, and the difference."""
    both = df.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col(team) == t, F.col(amount))), F.lit(0)).alias(f"__{t}") for t in (0, 1)))
    views = F.array(*(F.struct(F.lit(t).alias("team"), F.col(f"__{t}").alias("own"), F.col(f"__{1 - t}").alias("theirs")) for t in (0, 1)))
    return both.select(*by, F.inline(views)).withColumn("difference", F.col("own") - F.col("theirs"))


def projected(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Running totals at every sample."""
    w = running(keys, order)
    return df.select("*", *(F.sum(c).over(w).alias(n) for n, c in totals.items()))


def ledger(df: DataFrame, keys: list[str], order: list[str], obtained: Column, removed: Column, level: Column) -> DataFrame:
    """used = max(0, obtained so far - removed so far - present level)."""
    w = running(keys, order)
    staged = df.withColumn("obtained", F.sum(obtained).over(w)).withColumn("removed", F.sum(removed).over(w))
    return staged.withColumn("used", F.greatest(F.lit(0), F.col("obtained") - F.col("removed") - level))


def change_points(df: DataFrame, keys: list[str], order: list[str], total: Column) -> DataFrame:
    """The samples at which the running total changes, with it; a change-point form of a cumulative series."""
    w = running(keys, order)
    staged = df.withColumn("track", F.sum(total).over(w)).withColumn("__prev", F.lag("track").over(ordered(keys, order)))
    return staged.where(F.col("__prev").isNull() | (F.col("track") != F.col("__prev"))).drop("__prev")


def activity(df: DataFrame, keys: list[str], order: list[str], clock: str, idle_after: int, absent_share: float) -> DataFrame:
    """Observed time, time in gaps longer than idle_after, and whether those are at least absent_share of it."""
    gap = F.col(clock) - F.lag(clock).over(ordered(keys, order))
    summed = df.withColumn("__gap", gap).groupBy(*keys).agg(
        F.coalesce(F.sum("__gap"), F.lit(0)).alias("observed"), F.coalesce(F.sum(F.when(F.col("__gap") > idle_after, F.col("__gap"))), F.lit(0)).alias("missing")
    )
    return summed.withColumn("absent", F.col("missing") >= F.col("observed") * absent_share)


def mean_rate(df: DataFrame, entity: list[str], by: list[str]) -> DataFrame:
    """Events per entity and label, then each label's mean and maximum over the entities that have it."""
    counts = df.groupBy(*entity, *by).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.count("*").alias("entities"), F.sum("n").alias("events"), F.max("n").alias("most")).withColumn("mean", F.round(F.col("events") / F.col("entities"), 6))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, counted by rule (rules without any are reported with 0). A null rule counts as broken."""
    counts = df.agg(*(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(n) for n, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("n_broken")) for n in rules))
    return counts.select(F.inline(pairs))


def median_and_share(df: DataFrame, by: list[str], value: str, condition: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.round(F.avg(condition.cast("double")), 6).alias("share"))
