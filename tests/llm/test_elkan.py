import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from kairoframe.llm import elkan, queries, sql
from kairoframe.llm.vectors import whole

ROW = "vec_id long, embedding array<double>, cluster string, near int, ids int"


def brute(rows, width, k, rounds, scale=64):
    rows = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    at = [list(v) for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        near = [min((dist(v, c), j) for j, c in enumerate(at)) for _, v in rows]
        if r < rounds:
            for j in range(len(at)):
                own = [v for (_, v), (_, c) in zip(rows, near) if c == j]
                at[j] = [sum(x) // len(own) for x in zip(*own)] if own else at[j]
    sums, names = Counter(), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    for d, c in near:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), names[c]) for (i, _), (d, c) in zip(rows, near)), key=str)


def clusters(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], ROW).repartition(3)
    return sorted((tuple(r) for r in elkan.clusters(df, "vec_id", "embedding", **options).collect()), key=str)


def test_against_plain_rounds(spark):
    r = random.Random(1)
    for width, k, spread in ((3, 5, 0.3), (2, 9, 2.0), (1, 4, 1.0)):
        rows = [(i, [i % 6 + r.gauss(0, spread) for _ in range(width)]) for i in range(400)]
        assert clusters(spark, rows, width=width, k=k, slab=32) == brute(rows, width, k, 3)


def test_many_ties_and_repeated_vectors(spark):
    """Few whole places, so that most vectors are as near to one centroid as to another."""
    r = random.Random(2)
    rows = [(i, [r.randint(-1, 1) / 64, r.randint(-1, 1) / 64]) for i in range(300)] + [(i, [0.0, 0.0]) for i in range(300, 700)]
    for rounds in (0, 1, 3):
        assert clusters(spark, rows, width=2, k=16, rounds=rounds, slab=64) == brute(rows, 2, 16, rounds)


def test_rows_that_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(2, [2.0, 1.0]), (2, [9.0, 9.0]), (None, [4.0, 4.0]), (7, None), (8, [1.0]), (9, [1.0, 2.0, 3.0]), (10, [None, 1.0]), (11, [math.nan, 1.0]), (12, [1.0, -math.inf])]
    assert clusters(spark, rows, width=2, k=16) == brute(rows, 2, 16, 3)
    assert clusters(spark, [], width=2) == []
    assert clusters(spark, [(None, [1.0, 2.0])], width=2) == [(None,) * 6]
    with pytest.raises(ValueError, match="do not fit"):
        clusters(spark, [(1, [1e9, 0.0])], width=2)


def test_bounds_hold_and_skip_most_distances(spark):
    r = random.Random(4)
    rows = [(i, [10.0 * (i % 8) + r.gauss(0, 0.3), r.gauss(0, 0.3)]) for i in range(800)]
    x = whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64.0)
    slabs, at, spent = elkan.clustered(x, 2, elkan.starts(x, 8, "1"), 3, 100)
    assert sum(spent) < 0.5 * 4 * 800 * 8 and spent[-1] < 0.3 * 800 * 8
    for row in slabs.collect():
        v = np.frombuffer(row["cells"], f"i{row['item']}").astype(np.int64).reshape(-1, 2)
        d = np.sqrt(elkan.squared(v[:, None], at[None]).astype(float))
        near = np.frombuffer(row["near"], np.int32)
        assert (np.frombuffer(row["upper"], np.float32) >= d[np.arange(len(v)), near]).all()
        assert (np.frombuffer(row["lower"], np.float32).reshape(-1, 8) <= d).all()


def test_rounding_is_away_from_the_number():
    x = np.array([0.0, 1.0, 1 / 3, 16777217.0, 1e-30, 3e9 + 1])
    assert (elkan.below(x).astype(float) < x).all() and (elkan.above(x).astype(float) > x).all()


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = duck.sql(sql.OP12_ELKAN)
    df = queries.op12_elkan(spark, folder)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
