"""Events from live frames, with a lifecycle: confirmed while they may still change, finalized when they no longer can.

A stateful processor on Spark's arbitrary state with timers (transformWithStateInPandas): a list of rows that the watermark has not passed, and the matches' states: open demolitions by pair, counters by
player, events to publish and clocks. Each access to state is a round trip from Python to the JVM, so several matches with consecutive numbers share a key: its rows are kept as packed columns, and its
matches' states are read once and written once a timer. A timer fires when the watermark reaches the oldest waiting row, so rows are handled in the order of game time whatever the order
they came in; rows later than the watermark's delay are dropped, by Spark. Once a second of game time, and at the recording's end, what changed is published as numbered transactions of the match's log.

Each stream of events has a horizon, so much game time after an event's end it is finalized: demolitions as long as a further sighting would extend them, counted increments at once. Since projections
are tied to game time, the log does not depend on how the rows were cut into micro-batches.

rows(match_id, ms, kind, a, b): ``demolition`` (a: attacker, b: victim, once for each frame that it is seen), ``counter`` (a: player, b: value; the first value sets the baseline), ``end``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVERY = 1000
HORIZONS = {"demolition": 800, "increment": 0}
#: Rows of one moment are handled in this order.
KINDS = ["counter", "demolition", "end"]
COUNTER, DEMOLITION, END = range(3)
PACKED = ["match_id", "ms", "kind", "a", "b"]
EVENT = "stream string, event_id string, start_ms long, end_ms long, n long"
LOG = f"match_id long, seq long, at_ms long, lifecycle string, {EVENT}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOGETHER, MOST_ROWS = 16, 10_000


class Match:
    """One match's state, and what its rows publish."""

    def __init__(self) -> None:
        self.tick, self.seq = EVERY, 0
        self.open: dict[tuple[int, int], tuple[int, int, int, bool]] = {}  # by pair: start, end, sightings, whether published as it is
        self.counters: dict[int, int] = {}
        self.fresh: list[tuple] = []

    def handled(self, rows: list[list[int]]) -> list[tuple]:
        """Transactions of rows (ms, kind, a, b) in order."""
        out: list[tuple] = []
        for ms, kind, a, b in rows:
            while self.tick < ms:  # a projection sees all rows up to its moment
                if self.fresh or self.open:
                    out += self._project(self.tick)
                self.tick += EVERY
            if kind == END:
                out += self._project(ms, finish=True)
            elif kind == DEMOLITION:
                self._demolition(ms, a, b)
            else:
                self._counter(ms, a, b)
        return out

    def _demolition(self, ms: int, a: int, b: int) -> None:
        seen = self.open.get((a, b))
        if seen and ms - seen[1] <= HORIZONS["demolition"]:
            self.open[a, b] = (seen[0], ms, seen[2] + 1, False)
        else:
            if seen:
                self.fresh.append(self._event(a, b, *seen[:3]))
            self.open[a, b] = (ms, ms, 1, False)

    def _counter(self, ms: int, player: int, value: int) -> None:
        for number in range(self.counters.get(player, value) + 1, value + 1):
            self.fresh.append(("increment", f"increment:{player}:{number}", ms, ms, 1))
        self.counters[player] = value

    @staticmethod
    def _event(a: int, b: int, start: int, end: int, n: int) -> tuple:
        return ("demolition", f"demolition:{a}:{b}:{start}", start, end, n)

    def _project(self, at: int, finish: bool = False) -> list[tuple]:
        """Transactions of what changed since the projection before: revisions, and what has come to its horizon."""
        changed = [("finalized", *e) for e in self.fresh]
        self.fresh = []
        for (a, b), (start, end, n, published) in list(self.open.items()):
            over = finish or at - end > HORIZONS["demolition"]
            if over:
                del self.open[a, b]
            elif not published:
                self.open[a, b] = (start, end, n, True)
            if over or not published:
                changed.append(("finalized" if over else "confirmed", *self._event(a, b, start, end, n)))
        changed.sort(key=lambda e: e[2])
        out = [(self.seq + i, at, *e) for i, e in enumerate(changed)]
        self.seq += len(out)
        return out


class Generator(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.matches = handle.getValueState("matches", "states binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packed = [frame[PACKED].to_numpy(np.int64) for frame in rows]
        self.waiting.appendList([(p.tobytes(),) for p in packed])
        self.handle.registerTimer(int(min(p[:, 1].min() for p in packed)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, np.int64) for (p,) in self.waiting.get())]).reshape(-1, len(PACKED))
        now = rows[:, 1] <= mark
        if not now.any():  # another timer has fired before, for the same watermark
            return
        ready, later = rows[now], rows[~now]
        if len(later):
            self.waiting.put([(later.tobytes(),)])
            self.handle.registerTimer(int(later[:, 1].min()))
        else:
            self.waiting.clear()
        ready = ready[np.lexsort(ready.T[::-1])]
        states: dict[int, Match] = pickle.loads(self.matches.get()[0]) if self.matches.exists() else {}
        out: list[tuple] = []
        for part in np.split(ready, np.flatnonzero(np.diff(ready[:, 0])) + 1):
            match = int(part[0, 0])
            out += [(match, *row) for row in states.setdefault(match, Match()).handled(part[:, 1:].tolist())]
            if len(out) >= MOST_ROWS:
                yield self._log(out)
                out = []
        self.matches.update((pickle.dumps(states),))
        if out:
            yield self._log(out)

    @staticmethod
    def _log(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])

    def close(self) -> None:
        pass


def generated(rows: DataFrame, delay: str, together: int = TOGETHER) -> DataFrame:
    """rows: a streaming DataFrame with a timestamp ``ts`` of game time besides its columns; delay: by how much rows may come late; together: how many matches share a key, whose waiting rows are in
    memory at once when its timer fires (fewer for long matches). The log, in append mode. The session's state has to be kept in RocksDB (``state_in_rocksdb``)."""
    kind = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")) - 1
    group = F.expr(f"(match_id - pmod(match_id, {together})) div {together}")
    timed = rows.withWatermark("ts", delay).select(group.alias("group"), "match_id", "ms", kind.alias("kind"), "a", "b", "ts")
    return timed.groupBy("group").transformWithStateInPandas(Generator(), LOG, "append", "eventTime")


class state_in_rocksdb:  # noqa: N801
    """For the time of a ``with``: new streaming queries keep their state in RocksDB, as keyed state with timers needs, in at most two partitions a core: each is a store of its own that every micro-batch
    opens and commits, and what it holds lies on disk."""

    NAME, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"

    def __init__(self, spark) -> None:
        self.conf, self.cores = spark.conf, spark.sparkContext.defaultParallelism

    def __enter__(self) -> None:
        self.before = {name: self.conf.get(name) for name in (self.NAME, self.PARTITIONS)}
        self.conf.set(self.NAME, ROCKS)
        self.conf.set(self.PARTITIONS, str(min(int(self.before[self.PARTITIONS]), 2 * self.cores)))

    def __exit__(self, *_) -> None:
        for name, value in self.before.items():
            self.conf.set(name, value)


def violations(log: DataFrame) -> DataFrame:
    """What breaks the lifecycle's promises: match_id, seq, event_id, broken. A finalized event never changes, numbers are used once, and no event is finalized before its horizon but at the end."""
    by_event = Window.partitionBy("match_id", "event_id").orderBy("seq")
    horizon = F.element_at(F.create_map(*(F.lit(x) for kv in HORIZONS.items() for x in kv)), F.col("stream"))
    last = F.max("at_ms").over(Window.partitionBy("match_id"))
    rows = log.withColumn("__before", F.lag("lifecycle").over(by_event)).withColumn("__twice", F.count("*").over(Window.partitionBy("match_id", "seq")) > 1).withColumn("__last", last)
    broken = F.when(F.col("__twice"), "number used twice").when(F.col("__before") == "finalized", "changed after it was final").when(
        (F.col("lifecycle") == "finalized") & (F.col("at_ms") - F.col("end_ms") < horizon) & (F.col("at_ms") < F.col("__last")), "final before its horizon"
    )
    return rows.withColumn("broken", broken).where("broken IS NOT NULL").select("match_id", "seq", "event_id", "broken")


def current(log: DataFrame) -> DataFrame:
    """The table that the log leads to: the latest row of each event."""
    latest = F.row_number().over(Window.partitionBy("match_id", "event_id").orderBy(F.desc("seq")))
    return log.withColumn("__n", latest).where("__n = 1").drop("__n")
