"""The live generator and the change source on small recordings."""

from functools import partial
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairoframe.plans import lifecycle
from kairoframe.sources import recordings
from kairoframe.streaming import changes, generator, live
from kairoframe.streaming.arrivals import Arrivals

ROWS = "match_id long, ms long, kind string, a long, b long"
CASES = [
    # Seen three times within 0.8 s of each other, over a second's end, then anew; and once, by another pair.
    *((1, ms, "demolition", 7, 8) for ms in (900, 1500, 2100, 3000, 5200)),
    (1, 5900, "demolition", 8, 7),
    # The first value is the baseline; a counter may rise by two at once.
    *((1, ms, "counter", 7, v) for ms, v in ((300, 4), (1000, 5), (2200, 5), (4100, 7))),
    (1, 6100, "end", 0, 0),
    (2, 100, "demolition", 1, 2),
    (2, 200, "end", 0, 0),
]


def logged(spark, path, parts, part):
    rows = spark.createDataFrame(CASES, ROWS).withColumn("part", part).unionByName(spark.createDataFrame([(-1, 99_000, "end", 0, 0, parts)], f"{ROWS}, part int"))
    arrivals = Arrivals(rows.withColumn("ts", F.timestamp_millis("ms")), F.col("part"), parts + 1, path)
    with generator.state_in_rocksdb(spark):
        log = generator.generated(arrivals.stream().drop("part"), "10 seconds")
        arrivals.run(lambda: live.drained(log, path))
    return spark.read.schema(generator.LOG).parquet(f"{path}/rows")


def test_log_of_a_small_recording_however_it_is_cut(spark, tmp_path):
    before = spark.conf.get(generator.state_in_rocksdb.NAME)
    log = logged(spark, f"file://{tmp_path}/one", 1, F.lit(0)).cache()
    assert spark.conf.get(generator.state_in_rocksdb.NAME) == before
    got = [(r.at_ms, r.lifecycle, r.event_id, r.end_ms, r.n) for r in log.where("match_id = 1").orderBy("seq").collect()]
    assert got == [
        (1000, "confirmed", "demolition:7:8:900", 900, 1),
        (1000, "finalized", "increment:7:5", 1000, 1),
        (2000, "confirmed", "demolition:7:8:900", 1500, 2),
        (3000, "confirmed", "demolition:7:8:3000", 3000, 1),
        (3000, "finalized", "demolition:7:8:900", 2100, 3),
        (4000, "finalized", "demolition:7:8:3000", 3000, 1),
        (5000, "finalized", "increment:7:6", 4100, 1),
        (5000, "finalized", "increment:7:7", 4100, 1),
        (6000, "confirmed", "demolition:7:8:5200", 5200, 1),
        (6000, "confirmed", "demolition:8:7:5900", 5900, 1),
        (6100, "finalized", "demolition:7:8:5200", 5200, 1),
        (6100, "finalized", "demolition:8:7:5900", 5900, 1),
    ]
    assert [(r.seq, r.lifecycle) for r in log.where("match_id = 2").collect()] == [(0, "finalized")]
    assert generator.violations(log).count() == 0
    assert {r.lifecycle for r in generator.current(log).collect()} == {"finalized"}
    # Rows in reverse order, in three micro-batches: the same log.
    cut = logged(spark, f"file://{tmp_path}/cut", 3, F.lit(2) - F.floor(F.col("ms") / 2100).cast("int"))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, log.collect()))


@pytest.mark.parametrize(
    "rows,broken",
    [
        ([(0, 1000, "finalized", 100), (1, 2000, "finalized", 1500)], "changed after it was final"),
        ([(0, 1000, "confirmed", 900), (0, 3000, "finalized", 900)], "number used twice"),
        ([(0, 1000, "finalized", 900), (1, 9000, "confirmed", 9000)], "final before its horizon"),
    ],
)
def test_broken_promises_are_found(spark, rows, broken):
    log = spark.createDataFrame([(1, seq, at, life, "demolition", "e" if end < 5000 else "f", 0, end, 1) for seq, at, life, end in rows], generator.LOG)
    assert broken in {r.broken for r in generator.violations(log).collect()}


def test_two_drains_from_a_cursor_give_the_log_once(spark, tmp_path):
    schema = "seq long, name string"
    for n in range(5):
        spark.createDataFrame([(n, f"{n}-{i}") for i in range(n)], schema).repartition(2).write.parquet(f"file://{tmp_path}/log/number={n}")
    places = [f"file://{tmp_path}/log", schema, f"file://{tmp_path}/cursor", f"file://{tmp_path}/out"]
    changes.drain(spark, *places, until=3)
    first = {r.name for r in spark.read.schema(schema).parquet(places[3]).collect()}
    assert first == {"1-0", "2-0", "2-1"}
    changes.drain(spark, *places)
    spark.createDataFrame([(5, "late")], schema).write.parquet(f"file://{tmp_path}/log/number=5")
    changes.drain(spark, *places)
    changes.drain(spark, *places)
    every = [r.name for r in spark.read.schema(schema).parquet(places[3]).collect()]
    assert sorted(every) == sorted([*(f"{n}-{i}" for n in range(5) for i in range(n)), "late"])


class Counted:
    """A handle whose states live here and count how often they are used, as each use is a round trip to the JVM."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getValueState(self, *_):
        return self._state(None)

    def getListState(self, *_):
        return self._state([])

    def getMapState(self, *_):
        return self._state({})

    def _state(handle, held):  # noqa: N805
        class State:
            value = held

            def __getattribute__(self, name):
                handle.calls += name != "value"
                return object.__getattribute__(self, name)

            def exists(self):
                return self.value is not None

            def get(self):
                return self.value

            def update(self, value):
                self.value = value

            put = update

            def clear(self):
                self.value = type(held)() if held is not None else None

            def appendList(self, rows):
                self.value += rows

            def appendValue(self, row):
                self.value.append(row)

            def iterator(self):
                return iter(self.value.items())

            def containsKey(self, key):
                return key in self.value

            def getValue(self, key):
                return self.value[key]

            def updateValue(self, key, value):
                self.value[key] = value

            def removeKey(self, key):
                del self.value[key]

        return State()


def test_state_is_used_as_often_for_many_rows_as_for_few():
    def run(seconds):
        handle, processor = Counted(), generator.Generator()
        processor.init(handle)
        rows = [(m, ms, kind, 7, ms // 500 if kind == 0 else 8) for m in (3, 4) for ms in range(100, 1000 * seconds, 100) for kind in (0, 1)]
        frame = pd.DataFrame(rows, columns=["match_id", "ms", "kind", "a", "b"])
        out = [f for part in (frame[::2], frame[1::2]) for f in processor.handleInputRows((0,), iter([part]), None)]
        out += processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000 * seconds - 500), None)
        return handle, pd.concat(out)

    (few, _), (many, log) = run(4), run(60)
    assert many.calls == few.calls
    # Both matches alike: each has an increment in every half second, and its demolition confirmed anew in every second.
    assert all((log["match_id"] == m).sum() == 3 * 59 for m in (3, 4))
    # What the watermark has not passed waits, with a timer.
    assert 59_600 in many.timers


def test_partitions_of_the_state_are_bounded_by_cores(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        for asked, held in ((600, 2 * spark.sparkContext.defaultParallelism), (3, 3)):
            spark.conf.set(name, str(asked))
            with generator.state_in_rocksdb(spark):
                assert int(spark.conf.get(name)) == held
            assert int(spark.conf.get(name)) == asked
    finally:
        spark.conf.set(name, before)


def test_live_rows_take_one_pass_over_the_events(spark):
    rows = lifecycle.live_rows(recordings.frames(spark, "/root/testdata/sf0.001"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r[0]: r[1] for r in rows.groupBy("kind").count().collect()}.keys() == {"counter", "demolition", "end"}


def test_long_matches_share_no_key_and_the_log_does_not_depend_on_it(spark, tmp_path, monkeypatch):
    assert [lifecycle.matches_a_key(frames * 100) for frames in (0, 300, 5_000, 20_000, 100_000)] == [16, 16, 4, 1, 1]
    shared = logged(spark, f"file://{tmp_path}/shared", 1, F.lit(0)).collect()
    monkeypatch.setattr(generator, "generated", partial(generator.generated, together=1))
    alone = logged(spark, f"file://{tmp_path}/alone", 1, F.lit(0)).collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, shared))
