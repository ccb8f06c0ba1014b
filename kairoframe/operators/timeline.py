"""Timelines: streams of events in one table, their ids, and the changes between two states of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """All streams in one table with ``stream``; columns that a stream lacks are null."""
    named = [df.withColumn("stream", F.lit(name)) for name, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def with_event_ids(df: DataFrame, keys: list[str], stream: str, anchor: str, tie: list[str]) -> DataFrame:
    """event_key = <stream>:<anchor>:<k>, k counting events of one stream at one anchor: independent of when they were derived."""
    w = Window.partitionBy(*keys, stream, anchor).orderBy(*tie)
    return df.withColumn("event_key", F.concat_ws(":", F.col(stream), F.col(anchor).cast("string"), (F.row_number().over(w) - 1).cast("string")))


def changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What turns before into after: upsert (with the new values) or retract (with nulls) per key; equal rows are left out."""
    a = before.select(*keys, F.struct(*values).alias("__old"))
    b = after.select(*keys, F.struct(*values).alias("__new"))
    both = a.join(b, keys, "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    change = F.when(F.col("__new").isNull(), "retract").otherwise("upsert")
    return both.select(*keys, change.alias("change"), *(F.col(f"__new.{v}").alias(v) for v in values))
