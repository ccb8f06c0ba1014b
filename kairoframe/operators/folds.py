"""Operators whose next state depends on their own last decision: ordered folds.

An entity's rows come to one task in order and pass through a step function; memory is one state an entity, however many rows it
has, and the sort spills. The step functions are the same as in streaming/live.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]
Finish = Callable[[Any], list[tuple]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Any], step: Step, finish: Finish, schema: str) -> DataFrame:
    """schema: the keys' columns, then those of the rows that step and finish return. A step gets (state, row of order + columns) and returns
    the new state and rows to emit."""
    names = [*keys, *(c for c in [*order, *columns] if c not in keys)]
    out_type = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_type)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for key, group in groupby(rows, key=lambda r: r[:n_keys]):
            state = start()
            for row in group:
                state, emitted = step(state, row[n_keys:])
                out += [(*key, *e) for e in emitted]
                if len(out) >= 8192:
                    yield flush()
                    out = []
            out += [(*key, *e) for e in finish(state)]
        yield flush()

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_type)


def nothing(state: Any) -> list[tuple]:
    return []


def rate_limit(gap: int) -> Step:
    """Rows (clock, id): keeps one if the last kept one is at least gap before it. Emits (clock, id)."""

    def step(last, row):
        clock, id_ = row[:2]
        return (clock, [(clock, id_)]) if last is None or clock - last >= gap else (last, [])

    return step


def debounce(dwell: int) -> Step:
    """Rows (clock, id, state): a new state holds once it was seen without interruption for ``dwell``; emits (clock, id, state) with the state that
    holds. State: (holding, challenger, since)."""

    def step(s, row):
        clock, id_, seen = row[:3]
        holding, challenger, since = s
        if holding is None or seen == holding:
            s = (seen, None, None)
        elif seen != challenger:
            s = (holding, seen, clock)
        elif clock - since >= dwell:
            s = (seen, None, None)
        return s, [(clock, id_, s[0])]

    return step


def hysteresis(enter_below: int, leave_above: int, longest: int) -> Step:
    """Rows (clock, id, value): inside from a value below enter_below until one above leave_above, or for ``longest`` at most.
    Emits (clock, id, inside). State: when it was entered, or None."""

    def step(entered, row):
        clock, id_, value = row[:3]
        if entered is not None and (value > leave_above or clock - entered > longest):
            entered = None
        elif entered is None and value < enter_below:
            entered = clock
        return entered, [(clock, id_, int(entered is not None))]

    return step


def sessions(establish: int, relief: int) -> tuple[Step, Finish]:
    """Rows (clock, id, pressing 0/1): a session is established by pressing for ``establish`` without interruption, from where that began, and ends
    at its last pressing row once none followed for ``relief``. Emits (start, end, rows pressing). State: (candidate since, start, last, n)."""

    def close(s):
        return [(s[1], s[2], s[3])] if s[1] is not None else []

    def step(s, row):
        clock, _, pressing = row[:3]
        since, start, last, n = s
        emitted = []
        if start is not None and clock - last >= relief:
            emitted = [(start, last, n)]
            since = start = last = None
            n = 0
        if start is not None:
            if pressing:
                last, n = clock, n + 1
        elif pressing:
            since, n = (clock, 1) if since is None else (since, n + 1)
            if clock - since >= establish:
                start, last = since, clock
        else:
            since, n = None, 0
        return (since, start, last, n), emitted

    return step, close


def possession(quiet: int) -> tuple[Step, Finish]:
    """Rows (clock, id, owner): an owner takes hold by two touches running, not more than ``quiet`` apart, from the first of them; another's
    single touch challenges, two running take over; more than quiet without a touch ends the hold at the last touch of the owner.
    Emits (owner, start, end, touches). State: (owner, start, last, n, candidate, its clock)."""

    def close(s):
        return [s[:1] + s[1:4]] if s[0] is not None else []

    def step(s, row):
        clock, _, who = row[:3]
        owner, start, last, n, rival, at = s
        emitted = []
        if owner is not None and clock - last > quiet:
            emitted, owner = [(owner, start, last, n)], None
        if rival is not None and clock - at > quiet:
            rival = None
        if owner is not None and who == owner:
            return (owner, start, clock, n + 1, None, None), emitted
        if rival == who:
            if owner is not None:
                emitted = [*emitted, (owner, start, last, n)]
            return (who, at, clock, 2, None, None), emitted
        return (owner, start, last, n, who, clock), emitted

    return step, close


def greedy_match(width: int) -> Step:
    """Rows (clock, id, team, opens 0/1): a closing row takes the latest open row of another team not more than ``width`` before it; each is used
    once. Emits (opening id, closing id). State: open rows, the oldest first, pruned to the width."""

    def step(waiting, row):
        clock, id_, team, opens = row[:4]
        waiting = [w for w in waiting if clock - w[0] <= width]
        if opens:
            return [*waiting, (clock, id_, team)], []
        taken = next((w for w in reversed(waiting) if w[2] != team), None)
        return [w for w in waiting if w is not taken], [(taken[1], id_)] if taken else []

    return step


def in_flight(longest: int) -> tuple[Step, Finish]:
    """Rows (clock, id, what), what: arm, confirm, reset or any other: an armed candidate is confirmed, is dropped by a reset, is replaced by arming
    again, or expires after ``longest``. Emits (armed id, ended at, outcome). State: the candidate (clock, id) or None."""

    def step(candidate, row):
        clock, id_, what = row[:3]
        out = []
        if candidate and clock - candidate[0] > longest:
            out, candidate = [(candidate[1], candidate[0] + longest, "expired")], None
        if candidate and what in ("arm", "confirm", "reset"):
            out, candidate = [*out, (candidate[1], clock, {"arm": "replaced", "confirm": "confirmed", "reset": "dropped"}[what])], None
        return ((clock, id_) if what == "arm" else candidate), out

    def finish(candidate):
        return [(candidate[1], candidate[0], "open")] if candidate else []

    return step, finish


def role_debounce(dwell: int, margin: int) -> Step:
    """Rows (clock, id, leader, lead): the leader of a group holds until another has led by more than ``margin`` for ``dwell`` without interruption. Emits
    (clock, id, leader that holds). State: (holding, challenger, since)."""

    def step(s, row):
        clock, id_, leader, lead = row[:4]
        holding, challenger, since = s
        if holding is None:
            s = (leader, None, None)
        elif leader == holding or lead <= margin:
            s = (holding, None, None)
        elif leader != challenger:
            s = (holding, leader, clock)
        elif clock - since >= dwell:
            s = (leader, None, None)
        return s, [(clock, id_, s[0])]

    return step
