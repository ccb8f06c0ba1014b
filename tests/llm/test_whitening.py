import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from kairoframe.llm import queries, whitening
from kairoframe.llm.tables import read

ROW = "vec_id long, embedding array<double>, x int, n int, component string"


def kept(rows, scale=64, shift=1_000_000):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    return [(i, tuple(math.floor(scale * c) + shift for c in v) + (shift,) * (width - len(v))) for i, v in good]


def covariance(rows):
    """n, S and V over the distinct vectors, in fractions."""
    fit = sorted({x for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return n, sums, v


def check(rows, found, most=16):
    """Each result against V by its definition, without an eigensolver: V times a component is its eigenvalue times it."""
    rows = kept(rows)
    n, sums, v = covariance(rows)
    exact = {}
    for i, x in rows:
        exact.setdefault(i, []).append((x, sum((n * a - s) ** 2 for a, s in zip(x, sums))))
    width, trace = len(sums), sum(v[i][i] for i in range(len(sums)))
    assert Counter((r.vec_id, r.component) for r in found) == Counter((i, c) for i, _ in rows for c in range(1, min(most, width) + 1))
    assert {r.n for r in found} == {n}
    assert Counter((r.vec_id, r.deviation) for r in found if r.component == 1) == Counter((i, d) for i, _ in rows for d in [exact[i].pop(0)[1]] for d in [d if d < 1 << 63 else None])
    assert len({r.identity_error for r in found}) == 1
    by_hand = np.linalg.eigvalsh(np.array(v, float))[::-1]
    for c in range(1, min(most, width) + 1):
        share = {r.explained for r in found if r.component == c}
        assert len(share) == 1
        if trace:
            assert abs(share.pop() - max(by_hand[c - 1], 0) / float(trace)) < 1e-9
    return rows, n, sums, v


def whiten(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], ROW).repartition(3)
    return whitening.whiten(df, "vec_id", "embedding", **options).collect()


def projected(rows, found, n, sums, v):
    """The whitened values as a matrix, its covariance over distinct vectors, and V's as the projections see it."""
    value = {(r.vec_id, r.component): r.whitened for r in found}
    ids = {x: i for i, x in rows}
    k = max(r.component for r in found)
    z = np.array([[value[i, c] for c in range(1, k + 1)] for i in ids.values()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(k)).max() < 1e-9
    # x - S/n is a combination of the components: regressing it on z gives them back, unit vectors times roots of eigenvalues.
    off = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in ids])
    loads = z.T @ off / n
    values = (loads**2).sum(axis=1)
    assert np.allclose(np.array(v, float) @ loads.T, loads.T * values, rtol=1e-9, atol=1e-9 * values.max())
    return z


def test_against_fractions(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1 + d) + (d == 2) * r.gauss(0, 4) for d in range(6)]) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [rows[3]]
    found = whiten(spark, rows, most=4)
    z = projected(*[(kept_rows, found, n, s, v) for kept_rows, n, s, v in [check(rows, found, 4)]][0])
    assert z.shape == (150, 4) and found[0].identity_error < 1e-9
    same = {(x.component, x.whitened) for x in found if x.vec_id >= 1000 or x.vec_id == 7}
    assert len(same) == 4  # a vector given many times has one result


def test_all_components_and_sizes_far_apart(spark):
    """Eigenvalues that differ by 10^18: plain double precision would lose the small ones."""
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) * 10**e for e in (9, 6, 3, 0)]) for i in range(60)]
    found = whiten(spark, rows)
    kept_rows, n, sums, v = check(rows, found)
    assert found[0].identity_error < 1e-6
    share = [next(x.explained for x in found if x.component == c) for c in range(1, 5)]
    assert share[3] < 1e-17
    # The product of all eigenvalues is the determinant.
    det = whole_det(v)
    trace = sum(v[i][i] for i in range(4))
    assert abs(math.prod(share) / float(det / trace**4) - 1) < 1e-6


def whole_det(v):
    a, out = [list(row) for row in v], Fraction(1)
    for i in range(len(a)):
        out *= a[i][i]
        for k in range(i + 1, len(a)):
            f = a[k][i] / a[i][i]
            a[k] = [x - f * y for x, y in zip(a[k], a[i])]
    return out


def test_rows_that_take_no_part_and_components_without_spread(spark):
    rows = [(1, [0.5, 1.0, 0.0]), (2, [0.25, 1.0]), (2, [0.25, 1.0, 0.0]), (None, [1.5, 1.0, 0.0]), (4, None), (5, [None, 1.0, 1.0]), (6, [math.nan, 0.0, 0.0]), (7, [0.0, math.inf, 0.0]), (8, [])]
    found = whiten(spark, rows)
    check(rows, found)
    # Three dimensions, the last without spread: only two components have any.
    assert {(r.component, r.whitened is None, r.explained > 0) for r in found} == {(1, False, True), (2, False, True), (3, True, False)}
    assert whiten(spark, []) == [] and whiten(spark, [(1, None)]) == [] and whiten(spark, [(1, [])]) == []
    alone = whiten(spark, [(1, [1.0, 2.0]), (9, [1.0, 2.0])])
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(1, 0, None, None, None)} and len(alone) == 4


def test_large_entries_and_deviations_beyond_a_long(spark):
    rows = [(1, [2.0**40]), (2, [0.0]), (3, [-(2.0**40)]), (4, [1e300])]
    found = {r.vec_id: r for r in whiten(spark, rows)}
    assert set(found) == {1, 2, 3} and found[2].deviation == 0 and found[1].deviation is None
    assert abs(abs(found[1].whitened) - math.sqrt(1.5)) < 1e-12 and found[1].identity_error < 1e-12


@pytest.mark.parametrize("size", [1 << 19, 1 << 21, 1 << 45, 1 << 61, 1 << 90])
def test_digit_slices_are_exact(size):
    r = random.Random(size)
    kind = np.int64 if size < 1 << 62 else object
    y = np.array([[r.randint(-size, size) for _ in range(5)] for _ in range(300)], kind)
    parts = whitening.limbs(y)
    assert all((np.abs(p) < 1 << whitening.BITS).all() for p in parts)
    low, high = {}, {}
    whitening.products(y[:150], low, high)
    whitening.products(y[150:], low, high)
    got = sum(((high[p].astype(object) << 32) + low[p].astype(object)) << (whitening.BITS * p) for p in low)
    assert (got == y.astype(object).T @ y.astype(object)).all()


def test_deviations_in_longs_and_in_integers():
    x = np.array([[5, 1 << 50], [-3, 7]])
    for n in (7, 1 << 40):
        about = whitening.Centre(n, np.array([2, 3]), np.array([1, n - 1]))
        want = x.astype(object) * n - (about.whole.astype(object) * n + about.rest)
        got = about.deviations(x)
        assert (got == want).all() and got.dtype == (np.int64 if n == 7 else object)


def test_rotations_and_rank():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 16):
        a = r.integers(-9, 9, (n, n))
        m = (a @ a.T).astype(np.longdouble)
        values, unit = whitening.eigen(m)
        assert np.allclose((unit * values) @ unit.T, m, atol=1e-12) and np.allclose(unit.T @ unit, np.eye(n), atol=1e-15) and (np.diff(values) <= 0).all()
    b = r.integers(-5, 5, (7, 3)).astype(object)
    assert whitening.rank(b @ b.T) == 3 and whitening.rank(np.zeros((4, 4), object)) == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.op11_whitening(spark, folder).collect()
    rows = [tuple(r) for r in read(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    x = kept(rows)
    a = np.array([v for _, v in x], object)
    n, sums = len(set(map(tuple, a.tolist()))), a.sum(axis=0)
    assert len(found) == 16 * len(rows) and n == len(rows)
    y = a * n - sums
    want = dict(zip([i for i, _ in x], (y**2).sum(axis=1)))
    assert all(r.n == n and r.deviation == want[r.vec_id] and r.identity_error < 1e-9 for r in found)
    v = np.array(y.T @ y / Fraction(n**3), float)
    values, unit = np.linalg.eigh(v)
    z = np.array([r.whitened for r in sorted(found, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 16)
    by_hand = (y / n).astype(float) @ unit[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    order = np.argsort([i for i, _ in x])
    assert np.abs(np.abs(z) - np.abs(by_hand[order])).max() < 1e-6
