"""Column scans against the row steps that they stand for, and against each other over batches of any size."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairoframe.operators import folds, scans


def by_rows(step, start, columns):
    state, out = start, []
    for row in zip(*columns):
        state, emitted = step(state, row)
        out += emitted
    return out


def by_columns(scan, columns, cuts):
    state, out = None, []
    edges = sorted({0, len(columns[0]), *(c % (len(columns[0]) + 1) for c in cuts)})
    for a, b in zip(edges[:-1], edges[1:]):
        part = [np.array(c[a:b], dtype=object if isinstance(c[0], str) else np.int64) for c in columns]
        state, kept, more = scan(state, part)
        out += [(int(part[0][i]), int(part[1][i]), *(m[j] if isinstance(m[j], str) else int(m[j]) for m in more)) for j, i in enumerate(kept)]
    return out


CLOCKS = st.lists(st.integers(0, 4), min_size=1, max_size=40).map(lambda steps: np.cumsum(steps).tolist())


@settings(max_examples=150, deadline=None)
@given(CLOCKS, st.integers(0, 7), st.lists(st.integers(0, 60), max_size=4))
def test_rate_limit(clock, gap, cuts):
    columns = [clock, list(range(len(clock)))]
    assert by_columns(scans.rate_limit(gap), columns, cuts) == by_rows(folds.rate_limit(gap), None, columns)


@settings(max_examples=150, deadline=None)
@given(CLOCKS, st.data(), st.integers(0, 7), st.lists(st.integers(0, 60), max_size=4))
def test_debounce(clock, data, dwell, cuts):
    columns = [clock, list(range(len(clock))), data.draw(st.lists(st.sampled_from("xyz"), min_size=len(clock), max_size=len(clock)))]
    assert by_columns(scans.debounce(dwell), columns, cuts) == by_rows(folds.debounce(dwell), (None, None, None), columns)


@settings(max_examples=150, deadline=None)
@given(CLOCKS, st.data(), st.integers(1, 9), st.lists(st.integers(0, 60), max_size=4))
def test_hysteresis(clock, data, longest, cuts):
    columns = [clock, list(range(len(clock))), data.draw(st.lists(st.integers(0, 10), min_size=len(clock), max_size=len(clock)))]
    assert by_columns(scans.hysteresis(3, 6, longest), columns, cuts) == by_rows(folds.hysteresis(3, 6, longest), None, columns)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_entities_over_batches(spark, rows):
    data = [(f"e{i % 7}" if i % 11 else None, i, i) for i in range(400)]
    df = spark.createDataFrame(data, "p string, t long, id long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = scans.scanned(df, ["p"], ["t", "id"], [], scans.rate_limit(25), "p string, t long, id long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = folds.ordered_fold(df, ["p"], ["t", "id"], [], lambda: None, folds.rate_limit(25), folds.nothing, "p string, t long, id long").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert scans.scanned(df.limit(0), ["p"], ["t", "id"], [], scans.rate_limit(25), "p string, t long, id long").collect() == []
