import pytest
from pyspark.sql import functions as F

from kairoframe.functions import columns as C
from kairoframe.operators import features, folds, labels, matching, temporal, timeline
from kairoframe.sources import sinks

KEYS, ORDER = ["p"], ["t", "id"]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("a", 0, 0, "x", 10), ("a", 5, 1, "x", 30), ("a", 5, 2, "y", 30), ("a", 20, 3, None, 0), ("a", 22, 4, None, 90), ("b", 1, 5, "x", 50), (None, 3, 6, "y", 5)]
    return spark.createDataFrame(rows, "p string, t long, id long, s string, v long")


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_spans_tile_tracked_time(samples):
    spans = temporal.spans(samples, KEYS, ORDER, "t", F.col("s"))
    assert tuples(spans.where("p = 'a'"), "island", "state", "start", "end") == [(1, "x", 0, 5), (2, "y", 5, 20), (3, None, 20, 22)]
    tracked = samples.groupBy("p").agg((F.max("t") - F.min("t")).alias("d"))
    assert tuples(spans.groupBy("p").agg(F.sum(F.col("end") - F.col("start")).alias("d")), "p", "d") == tuples(tracked, "p", "d")


def test_window_boundaries_are_closed(spark):
    left = spark.createDataFrame([("a", 0, 1)], "p string, t long, id long")
    right = spark.createDataFrame([("a", t) for t in (-1, 0, 9, 10, 11)], "p string, u long")
    assert tuples(matching.in_window(left, right, KEYS, "t", "u", 0, 10), "u") == [(0,), (9,), (10,)]
    assert tuples(matching.in_window(left, right, KEYS, "t", "u", 1, 10), "u") == [(9,), (10,)]


def test_as_of_does_not_see_its_own_moment_and_goes_stale(spark):
    left = spark.createDataFrame([("a", 10, 5), ("a", 30, 6), ("b", 1, 7)], "p string, t long, id long")
    right = spark.createDataFrame([("a", 10, 5, "same"), ("a", 9, 9, "early"), ("a", 10, 4, "tie")], "p string, t long, id long, w string")
    assert tuples(matching.as_of(left, right, KEYS, "t", "id", ["w"]), "id", "last_w") == [(5, "tie"), (6, "same"), (7, None)]
    assert tuples(matching.as_of(left, right, KEYS, "t", "id", ["w"], 5), "id", "last_w") == [(5, "tie"), (6, None), (7, None)]


def test_running_totals_equal_partial_sums(samples):
    total = labels.projected(samples, KEYS, ORDER, {"so_far": F.col("v")})
    last = temporal.ranked(total, KEYS, [F.desc("t"), F.desc("id")]).where("rank = 1")
    assert tuples(last, "p", "so_far") == tuples(samples.groupBy("p").agg(F.sum("v").alias("so_far")), "p", "so_far")


def test_folds(spark):
    rows = [("a", t, t, c) for t, c in enumerate("AABBBAB")]
    df = spark.createDataFrame(rows, "p string, t long, id long, s string")
    step, finish = folds.possession(10)
    got = folds.ordered_fold(df, KEYS, ORDER, ["s"], lambda: (None, None, None, 0, None, None), step, finish, "p string, who string, start long, end long, n long")
    assert tuples(got, "start", "who", "end", "n") == [(0, "A", 1, 2), (2, "B", 6, 4)]
    limited = folds.ordered_fold(df, KEYS, ORDER, [], lambda: None, folds.rate_limit(3), folds.nothing, "p string, t long, id long")
    assert tuples(limited, "t") == [(0,), (3,), (6,)]
    empty = folds.ordered_fold(df.limit(0), KEYS, ORDER, [], lambda: None, folds.rate_limit(3), folds.nothing, "p string, t long, id long")
    assert empty.collect() == []


def test_unknown_feature_is_an_error():
    registry = features.Registry()
    registry.feature("v")(lambda: [("v", F.col("v"))])
    with pytest.raises(KeyError, match="nothing"):
        registry.columns(["v", "nothing"])
    with pytest.raises(ValueError, match="already"):
        registry.feature("v")(lambda: [])


def test_headers_repeat_members(spark):
    registry = features.Registry()
    registry.feature("v")(lambda: [("v", F.col("v")), ("w", F.col("v") * 2)])
    assert registry.headers(["v"], ["m0", "m1"]) == ["m0_v", "m0_w", "m1_v", "m1_w"]


def test_changes_turn_before_into_after(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k long, v string")
    assert tuples(timeline.changes(before, after, ["k"], ["v"]), "k", "change", "v") == [(2, "upsert", "c"), (4, "upsert", "d")]
    assert tuples(timeline.changes(after, before, ["k"], ["v"]), "k", "change", "v") == [(2, "upsert", "b"), (4, "retract", None)]


def test_scores_and_ratios(spark):
    row = spark.range(1).select(
        C.unit_score(F.lit(5.0), 0, 10).alias("a"), C.unit_score(F.lit(5.0), 10, 0).alias("b"), C.unit_score(F.lit(50.0), 0, 10).alias("c"), C.safe_ratio(F.lit(1.0), F.lit(0)).alias("d"), C.band(F.lit(None).cast("int"), [(1, "x")], "y").alias("e")
    ).first()
    assert tuple(row) == (0.5, 0.0, 1.0, 0.0, None)


def test_quaternions(spark):
    half = 2**-0.5
    turn = tuple(map(F.lit, (0.0, 0.0, half, half)))  # a quarter about z
    v = tuple(map(F.lit, (1.0, 0.0, 0.0)))
    row = spark.range(1).select(*C.rotate(turn, v), *C.rotate(C.conjugate(turn), C.rotate(turn, v)), *C.slerp(tuple(map(F.lit, (0.0, 0.0, 0.0, 1.0))), turn, 0.5), *C.euler_xyz(turn)).first()
    want = (0, 1, 0, 1, 0, 0, 0, 0, 0.38268343, 0.92387953, 0, 0, 1.57079633)
    assert all(abs(a - b) < 1e-6 for a, b in zip(row, want))


def test_json_and_nested_sinks(samples, tmp_path):
    assert sinks.as_json(samples.where("id = 5"), ["p", "id"]).first().document == '{"t":1,"s":"x","v":50}'
    nested = sinks.nested_export(samples, KEYS, ORDER)
    assert [r.id for r in nested.where("p = 'a'").first()["rows"]] == [0, 1, 2, 3, 4]
    sinks.write_partitioned(samples, str(tmp_path / "out"), ["p"])
    assert samples.sparkSession.read.parquet(str(tmp_path / "out")).where("p = 'a'").count() == 5


def test_stream_equals_batch(spark, tmp_path):
    from kairoframe.streaming import live

    rows = [("a" if i % 3 else "b", i * 7, i) for i in range(60)]
    df = spark.createDataFrame(rows, "p string, t long, id long").withColumn("ts", F.timestamp_millis(F.col("t") * 1000 + 10**9))
    df.repartition(4).write.parquet(str(tmp_path / "data" / "in"))
    # A last row far ahead moves the watermark past all others.
    spark.createDataFrame([("z", 10**6, 999)], "p string, t long, id long").withColumn("ts", F.timestamp_millis(F.col("t") * 1000 + 10**9)).write.mode("append").parquet(str(tmp_path / "data" / "late"))
    batch = folds.ordered_fold(df, KEYS, ORDER, [], lambda: None, folds.rate_limit(30), folds.nothing, "p string, t long, id long")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "data" / "*"))
    out = live.folded_stream(stream, KEYS, ORDER, [], "ts", "1 second", lambda: None, folds.rate_limit(30), folds.nothing, "p string, t long, id long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    query = out.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("kept").where("p <> 'z'")
    assert tuples(got, "p", "t", "id") == tuples(batch, "p", "t", "id")


def fold(spark, rows, columns, start, step, finish, schema):
    df = spark.createDataFrame([("a", *r) for r in rows], f"p string, t long, id long, {columns}")
    names = [c.split()[0] for c in columns.split(", ")]
    return [tuple(r)[1:] for r in folds.ordered_fold(df, KEYS, ORDER, names, start, step, finish, f"p string, {schema}").collect()]


def test_greedy_match_uses_each_row_once(spark):
    rows = [(0, 1, 0, 1), (1, 2, 0, 1), (2, 3, 1, 0), (2, 4, 1, 0), (2, 5, 1, 0), (9, 6, 0, 1), (13, 7, 1, 0), (14, 8, 0, 1), (15, 9, 0, 0)]
    assert fold(spark, rows, "team int, opens int", list, folds.greedy_match(3), folds.nothing, "a long, b long") == [(2, 3), (1, 4)]


def test_in_flight_outcomes(spark):
    step, finish = folds.in_flight(5)
    rows = [(0, 1, "arm"), (2, 2, "confirm"), (3, 3, "arm"), (4, 4, "arm"), (5, 5, "reset"), (6, 6, "arm"), (20, 7, "other"), (21, 8, "arm")]
    assert fold(spark, rows, "what string", lambda: None, step, finish, "id long, at long, outcome string") == [(1, 2, "confirmed"), (3, 4, "replaced"), (4, 5, "dropped"), (6, 11, "expired"), (8, 21, "open")]


def test_role_debounce(spark):
    rows = [(0, 0, "x", 9), (1, 1, "y", 9), (2, 2, "y", 1), (3, 3, "y", 9), (4, 4, "y", 9), (5, 5, "y", 9), (6, 6, "x", 0)]
    assert [r[2] for r in fold(spark, rows, "who string, lead int", lambda: (None, None, None), folds.role_debounce(2, 5), folds.nothing, "t long, id long, who string")] == ["x"] * 5 + ["y"] * 2


def test_clips(spark, samples):
    from kairoframe.sources import clips

    got = clips.clip(samples.where("p = 'a'"), "t", 5, 20, 5)
    assert tuples(got, "id", "in_clip") == [(0, False), (1, True), (2, True), (3, True)]
    assert tuples(clips.snapshot(samples, KEYS, ORDER, "t", "s", 20).where("p = 'a'"), "s", "t") == [("y", 20)]
    events = samples.where("id = 2").select("p", "t")
    assert tuples(clips.around(events, samples, KEYS, "t", 5, 15), "id", "event_t") == [(0, 5), (1, 5), (2, 5), (3, 5)]
