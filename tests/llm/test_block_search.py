import math
import random

import numpy as np
from pyspark.sql import functions as F

from kairoframe.llm import block_search


def brute(rows, k, every):
    rows = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in rows:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def search(spark, rows, every=5, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    return {tuple(r) for r in block_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % every == 0, **options).collect()}


def test_against_brute_force_in_small_blocks(spark):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 5]]) for i in range(300)]
    assert search(spark, rows, span=40, chunk=16, block=8) == brute(rows, 5, 5)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(3, [1.0, 0.0]), (40, None), (45, [None, 1.0]), (50, [float("nan"), 1.0]), (55, [float("inf"), 0.0]), (None, [1.0, 1.0]), (60, []), (65, [0.5])]
    assert search(spark, rows, span=7, chunk=3, block=2) == brute(rows, 5, 5)


def test_few_rows_and_none(spark):
    assert search(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 256 * 512)}
    assert search(spark, [(0, [1.0])]) == set()
    assert search(spark, []) == set()


def test_large_components_stay_exact(spark):
    rows = [(0, [3e5, 1.0]), (1, [3e5, 1 / 256]), (2, [3e5, 2 / 256])]
    assert search(spark, rows) == brute(rows, 5, 5)


def test_rounds_of_few_queries_and_rows_of_one_id(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(120)] + [(7, [2.0, 0.0, 0.0, 0.0])]
    for options in ({"chunk": 1}, {"chunk": 5, "span": 9, "block": 4}, {"span": 1, "block": 1}):
        assert search(spark, rows, **options) == brute(rows, 5, 5)


def test_blocks_below_the_thresholds_are_not_scored():
    r = np.random.default_rng(3)
    ids = np.arange(4000)
    matrix = np.round(256 * (np.eye(20)[ids // 200] + r.normal(0, 0.02, (4000, 20)))).astype(np.int64)
    queries = block_search.seeded(ids[::50], matrix[::50], 3)
    assert (queries.least > block_search.NONE).all()
    task = block_search.Search(queries, 3)
    for a in range(0, 4000, 1000):
        span = matrix[a : a + 1000]
        cuts = np.arange(0, 1000, 100)
        task.look(ids[a : a + 1000], span, np.minimum.reduceat(span, cuts), np.maximum.reduceat(span, cuts), 100)
    who, found, scores = task.settle()
    assert task.scored < 0.15 * task.bounded
    for q in (0, 17, 79):
        want = sorted(((-int(matrix[50 * q] @ v), i) for i, v in enumerate(matrix) if i != 50 * q))[:3]
        assert [(-s, i) for i, s in zip(found[who == q].tolist(), scores[who == q].tolist())] == want
