"""Parts of a recording: a range of samples with a lead-in, and the state that holds where it begins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip(samples: DataFrame, clock: str, start, end, lead_in=0) -> DataFrame:
    """Samples from ``lead_in`` before start to end, both included, with ``in_clip``: false in the lead-in. The range reaches the scan."""
    return samples.where((F.col(clock) >= start - lead_in) & (F.col(clock) <= end)).withColumn("in_clip", F.col(clock) >= start)


def snapshot(changes: DataFrame, keys: list[str], order: list[str], clock: str, value: str, at) -> DataFrame:
    """The last non-null value of each key before ``at``: a synthetic key frame. Combined before the shuffle; no ordering of the log."""
    known = changes.where((F.col(clock) < at) & F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value)).withColumn(clock, F.lit(at))


def around(events: DataFrame, samples: DataFrame, keys: list[str], clock: str, before: int, after: int) -> DataFrame:
    """The samples from ``before`` ahead of each event to ``after`` behind it, with the event's columns as event_<name>."""
    from kairoframe.operators.matching import in_window

    named = events.select(*keys, *(F.col(c).alias(f"event_{c}") for c in events.columns if c not in keys)).withColumn("__from", F.col(f"event_{clock}") - before)
    return in_window(named, samples, keys, "__from", clock, 0, before + after).drop("__from")
