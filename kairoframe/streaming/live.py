"""The live path: the batch operators' step functions as keyed state in Structured Streaming.

Events come in any order within a watermark's delay; each key's rows are buffered in its state until the watermark has passed them, then sorted
and folded with the same steps as operators/folds.py. Rows later than the watermark are dropped, by Spark. What a drained stream still holds is
flushed by a batch job over its state (``flushed``), so that stream and flush together give what the batch gives.

Results that are projected anew with every micro-batch are published as a change log (``publish``): upserts and retractions against the table that the
last micro-batch left, both in the shared folder; so a restarted query goes on where it was.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kairoframe.operators import timeline
from kairoframe.operators.folds import Finish, Step

STATE = "state binary"
LONG_AFTER = 10_000


def folded_stream(events: DataFrame, keys: list[str], order: list[str], columns: list[str], time: str, delay: str, start: Callable[[], Any], step: Step, finish: Finish, schema: str) -> DataFrame:
    """events: a streaming DataFrame with an event-time column ``time`` (a timestamp). Emits the rows of step and finish, in append mode; a key is
    finished when the watermark is past its last row by more than the delay and nothing came since."""
    names = [*keys, *(c for c in [*order, *columns] if c not in keys)]
    n_keys = len(keys)
    out_columns = [f.split()[0] for f in schema.split(", ")]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting, last = pickle.loads(group.get[0]) if group.exists else (start(), [], 0)
        for frame in frames:
            waiting += [(int(t), tuple(r)) for t, r in zip(frame["__ms"], frame[names].itertuples(index=False))]
        mark = group.getCurrentWatermarkMs()
        ready = sorted((r for t, r in waiting if t < mark or group.hasTimedOut), key=lambda r: r[n_keys : n_keys + len(order)])
        waiting = [] if group.hasTimedOut else [(t, r) for t, r in waiting if t >= mark]
        out = []
        for row in ready:
            state, emitted = step(state, row[n_keys:])
            out += [(*key, *e) for e in emitted]
        if group.hasTimedOut:
            out += [(*key, *e) for e in finish(state)]
            group.remove()
        else:
            last = max([last, *(t for t, _ in waiting)])
            group.update((pickle.dumps((state, waiting, last)),))
            group.setTimeoutTimestamp(max(last, mark) + LONG_AFTER)
        yield pd.DataFrame(out, columns=out_columns)

    timed = events.withWatermark(time, delay).select(*names, time, F.unix_millis(time).alias("__ms"))
    return timed.groupBy(*keys).applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def flushed(spark: SparkSession, checkpoint: str, keys: list[str], order: list[str], step: Step, finish: Finish, schema: str) -> DataFrame:
    """The rows that a folded_stream, ended and checkpointed there, had not yet emitted: of the samples still in its state, and of each key's end."""
    n_keys = len(keys)
    out_columns = [f.split()[0] for f in schema.split(", ")]

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *key, raw in frame.itertuples(index=False):
                state, waiting, _ = pickle.loads(raw)
                for _, row in sorted(waiting, key=lambda r: r[1][n_keys : n_keys + len(order)]):
                    state, emitted = step(state, row[n_keys:])
                    out += [(*key, *e) for e in emitted]
                out += [(*key, *e) for e in finish(state)]
            yield pd.DataFrame(out, columns=out_columns)

    held = spark.read.format("statestore").load(checkpoint)
    return held.select(*(F.col(f"key.{k}").alias(k) for k in keys), F.col("value.groupState.state").alias("state")).mapInPandas(rest, schema)


def drained(query_rows: DataFrame, path: str) -> DataFrame:
    """Run a streaming DataFrame over all input that there is, appending its rows to path/rows with its progress in path/progress; the rows."""
    spark = query_rows.sparkSession
    stream = query_rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress").option("path", f"{path}/rows")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(query_rows.schema).parquet(f"{path}/rows")


def publish(projected: DataFrame, number: int, path: str, keys: list[str], values: list[str]) -> None:
    """For foreachBatch: writes the changes from the table of the micro-batch before to this projection, and the projection for the next. Each
    micro-batch has its own folders, so that one that runs again writes the same."""
    spark = projected.sparkSession
    schema = projected.select(*keys, *values).schema
    # What the last micro-batch before this one left.
    tables = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).parquet(f"{path}/table/number={number - 1}")
    changes = timeline.changes(tables, projected, keys, values).withColumn("seq", F.lit(number).cast("long"))
    changes.write.mode("overwrite").parquet(f"{path}/changes/number={number}")
    projected.select(*keys, *values).write.mode("overwrite").parquet(f"{path}/table/number={number}")


def replayed(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table that a change log (seq, change, keys, values) leads to: the last change of each key, if it is no retraction."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq"))))
    return last.where("__n = 1 AND change = 'upsert'").drop("__n", "seq", "change")
