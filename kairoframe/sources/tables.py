"""Tables of a folder, one Parquet file or directory each, and the bindings of the temporal operators to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str):
    """A timestamp without time zone as microseconds, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    """events as samples: entity user_id, order (us, event_id), state event_type, scalar cents, counter k, team."""
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        micros("ts").alias("us"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("user_id") % 2).alias("team"),
    )


def order_samples(spark: SparkSession, folder: str) -> DataFrame:
    """orders as samples: entity custkey, order (us, orderkey), amount cents, labels status and priority."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        micros("o_orderdate").alias("us"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
