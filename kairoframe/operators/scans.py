"""Ordered folds over whole columns: the same decisions as the steps of folds.py, made by array searches from one change of state to the next.

A scan gets an entity's rows as they come, one Arrow batch's share at a time, and the state that the share before left. Python runs once a change of state,
not once a row; memory is a batch and one state. The sort before it spills, and no entity is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: (state, columns of order and others) -> (state, rows of the share that go out, further columns of these)
Scan = Callable[[Any, list[np.ndarray]], tuple[Any, np.ndarray, list[np.ndarray]]]


def scanned(df: DataFrame, keys: list[str], order: list[str], columns: list[str], scan: Scan, schema: str) -> DataFrame:
    """schema: the keys' columns, those of order, then those that scan adds."""
    names = [*keys, *(c for c in [*order, *columns] if c not in keys)]
    out_type = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_type)
    n_keys, n_kept = len(keys), len(keys) + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            change = np.zeros(batch.num_rows, bool)
            for c in batch.columns[:n_keys]:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change)])
            rows, added = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                here = tuple(batch.column(i)[a].as_py() for i in range(n_keys))
                if here != entity:
                    entity, state = here, None
                state, kept, more = scan(state, [x[a:b] for x in arrays[n_keys:]])
                rows.append(kept + a)
                added.append(more)
            at = pa.array(np.concatenate(rows).astype(np.int64))
            more = [np.concatenate(x) for x in zip(*added)]
            kept_columns = [batch.column(i).take(at).cast(arrow.field(i).type) for i in range(n_kept)]
            yield pa.RecordBatch.from_arrays([*kept_columns, *(pa.array(x, arrow.field(n_kept + i).type, from_pandas=True) for i, x in enumerate(more))], schema=arrow)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_type)


def rate_limit(gap: int) -> Scan:
    """Columns clock, id: keeps a row if the last kept one is at least gap before it. State: the clock of the last kept row."""

    def scan(last, columns):
        clock = columns[0]
        kept = []
        i = 0 if last is None else int(np.searchsorted(clock, last + gap))
        while i < len(clock):
            kept.append(i)
            last = int(clock[i])
            i = max(i + 1, int(np.searchsorted(clock, last + gap)))
        return last, np.array(kept, np.int64), []

    return scan


def debounce(dwell: int) -> Scan:
    """Columns clock, id, state: adds the state that holds: a new one does once it was seen without interruption for ``dwell``. State: (holding, challenger, since)."""

    def scan(s, columns):
        clock, seen = columns[0], columns[2]
        holding, challenger, since = s or (None, None, None)
        out = np.empty(len(seen), object)
        cuts = [0, *(np.flatnonzero(seen[1:] != seen[:-1]) + 1).tolist(), len(seen)]
        for a, b in zip(cuts[:-1], cuts[1:]):  # runs of equal states
            value = seen[a]
            if holding is None or value == holding:
                holding, challenger, since = value, None, None
                out[a:b] = holding
                continue
            first = a
            if value != challenger:
                challenger, since, first = value, int(clock[a]), a + 1
            k = max(first, int(np.searchsorted(clock[:b], since + dwell)))
            out[a : min(k, b)] = holding
            if k < b:
                holding, challenger, since = value, None, None
                out[k:b] = holding
        return (holding, challenger, since), np.arange(len(seen)), [out]

    return scan


def hysteresis(enter_below: int, leave_above: int, longest: int) -> Scan:
    """Columns clock, id, value: adds inside (0/1): from a value below enter_below until one above leave_above, or for ``longest`` at most. State: when it was entered."""

    def scan(entered, columns):
        clock, value = columns[0], columns[2]
        below, above = np.flatnonzero(value < enter_below), np.flatnonzero(value > leave_above)
        inside = np.zeros(len(clock), np.int64)

        def from_(positions: np.ndarray, i: int) -> int:
            at = int(np.searchsorted(positions, i))
            return int(positions[at]) if at < len(positions) else len(clock)

        i = 0
        while i < len(clock):
            if entered is None:
                i = from_(below, i)
                if i == len(clock):
                    break
                entered, first = int(clock[i]), i
                i += 1
            else:
                first = i
            end = min(from_(above, i), max(i, int(np.searchsorted(clock, entered + longest, side="right"))))
            inside[first:end] = 1
            if end < len(clock):
                entered = None
            i = end + 1
        return entered, np.arange(len(clock)), [inside]

    return scan
