"""Whitening of vectors with an exact covariance: matrix products over digit slices.

1. Vectors become whole numbers x. The fit list holds each distinct x once: n vectors with sums S.
2. Each is centred without a division, y = n * x - S, and |y| is split into limbs of 20 bits that keep y's sign. A product of two limb matrices of 4096 rows stays
   below 2^52, so float64 BLAS gives its exact value. Products of limbs i and j belong to the power i + j of 2^20.
3. A task adds up its products by power as two longs, the low 32 bits and the rest. Their sums over all tasks are big integers, which recombine to
   M, the sum of y y'. The covariance is V = M / n^3, each entry rounded once from a fraction.
4. V's eigenvectors come from Jacobi rotations in extended precision on the driver, whose rounding errors are relative to each pair of entries and not to the largest. How many
   eigenvalues are above zero is the rank of M modulo a large prime.
5. The rows are projected, (y / n) times the unit eigenvectors over the roots of their eigenvalues. The covariance of the projected fit list is measured on them.

The driver holds the covariance, whose size is the square of the dimension, however many vectors there are. What is repeated is told apart before anything is summed up,
so a vector that is a third of all rows weighs as one.

Cases: rows whose vector is null or holds a null or non-finite entry (or one of 2^61 or more after scaling) are left out; shorter vectors count as padded with zeros; an id may
be null or repeated, each row gets its own result. Components without spread (eigenvalue zero) have a null ``whitened``; without any, ``explained`` and ``identity_error`` are null
too. A ``deviation`` beyond a long is null. An empty table gives an empty result. Equal eigenvalues are numbered as the rotations leave them. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.storage import write_shared
from kairoframe.llm.vectors import matrix, whole

BITS, ROWS = 20, 4096  # 2 * 20 + 12 bits stay below the 53 of a float64
PRIME = (1 << 61) - 1
LONG = 1 << 63


class Centre(NamedTuple):
    """n and, of each dimension, S = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: as longs where they fit, else as Python's integers."""
        off = x - self.whole
        if int(np.abs(off).max(initial=0)) * self.n + self.n >= 1 << 62:
            off = off.astype(object)
        return off * self.n - self.rest


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = the sum of limbs[i] * 2^(20 i), each limb below 2^20 in size and with y's sign."""
    size, sign = np.abs(y), np.where(y < 0, -1.0, 1.0)
    n = max(1, -(-int(size.max(initial=0)).bit_length() // BITS))
    return [((size >> (BITS * i)) & ((1 << BITS) - 1)).astype(np.float64) * sign for i in range(n)]


def products(y: np.ndarray, low: dict[int, np.ndarray], high: dict[int, np.ndarray]) -> None:
    """Add y' y to the sums by power, as low 32 bits and the rest. At most ROWS rows."""
    parts = limbs(y)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            exact = (a.T @ parts[j]).astype(np.int64)
            exact = exact if i == j else exact + exact.T
            low[i + j] = low.get(i + j, 0) + (exact & 0xFFFFFFFF)
            high[i + j] = high.get(i + j, 0) + (exact >> 32)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield matrix(batch.column(column).slice(a, ROWS), width)


def centre(fit: DataFrame, width: int) -> Centre:
    """n and S of the fit list; sums of longs as low 32 bits and the rest, so that they never run over."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _blocks(batches, 0, width):
            n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(width), pa.int32()), "n": np.full(width, n), "low": low, "high": high})

    rows = fit.mapInArrow(total, "d int, n long, low long, high long").groupBy("d").agg(F.sum("n"), *(F.sum(F.col(c).cast("decimal(20,0)")) for c in ("low", "high"))).collect()
    sums = {d: (int(high) << 32) + int(low) for d, _, low, high in rows}
    n = rows[0][1]
    return Centre(n, *(np.array([f(sums[d]) for d in range(width)], np.int64) for f in (lambda s: s // n, lambda s: s % n)))


def scatter(fit: DataFrame, width: int, about: Centre) -> np.ndarray:
    """M, the exact sum of y y' over the fit list, as Python's integers."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for x in _blocks(batches, 0, width):
            products(about.deviations(x), low, high)
        i, j = np.triu_indices(width)
        for power in low:
            yield pa.RecordBatch.from_pydict(
                {"power": pa.array(np.full(len(i), power), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "low": low[power][i, j], "high": high[power][i, j]}
            )

    parts = fit.mapInArrow(multiply, "power int, i int, j int, low long, high long")
    m = np.zeros((width, width), object)
    for power, i, j, low, high in parts.groupBy("power", "i", "j").agg(*(F.sum(F.col(c).cast("decimal(20,0)")) for c in ("low", "high"))).collect():
        m[i, j] += ((int(high) << 32) + int(low)) << (BITS * power)
    return np.triu(m) + np.triu(m, 1).T


def rank(m: np.ndarray) -> int:
    """Of a matrix of integers, modulo a prime of 61 bits (less than its rank only with a chance of about width / 2^61)."""
    left, found = m % PRIME, 0
    for column in range(left.shape[1]):
        rows = np.flatnonzero(left[found:, column])
        if len(rows):
            at = found + rows[0]
            left[[found, at]] = left[[at, found]]
            pivot = left[found] * pow(int(left[found, column]), -1, PRIME) % PRIME
            left[found + 1 :] = (left[found + 1 :] - left[found + 1 :, column, None] * pivot) % PRIME
            found += 1
    return found


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs below n, in rounds of pairs that have no number in common."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], reversed(ring)) if max(a, b) < n]
        yield tuple(np.array(side, int) for side in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        ring = [ring[0], ring[-1], *ring[1:-1]]


def eigen(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, in v's precision."""
    a, q = v.copy(), np.eye(len(v), dtype=v.dtype)
    least = np.finfo(v.dtype).eps
    for _ in range(sweeps):
        turned = False
        for p, r in _rounds(len(a)):
            pp, rr, pr = a[p, p], a[r, r], a[p, r]
            turn = np.abs(pr) > least * np.sqrt(np.abs(pp * rr))
            if not turn.any():
                continue
            turned, p, r, pp, rr, pr = True, p[turn], r[turn], pp[turn], rr[turn], pr[turn]
            ratio = (rr - pp) / (2 * pr)
            t = np.where(ratio < 0, -1, 1) / (np.abs(ratio) + np.sqrt(1 + ratio * ratio))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            for side in (a, a.T, q):
                left, right = side[:, p] * c - side[:, r] * s, side[:, p] * s + side[:, r] * c
                side[:, p], side[:, r] = left, right
            a[p, p], a[r, r] = pp - t * pr, rr + t * pr
            a[p, r] = a[r, p] = 0
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order] / np.sqrt((q[:, order] ** 2).sum(axis=0))


def _extended(value: Fraction) -> np.longdouble:
    """The fraction, in extended precision where the machine has it."""
    top = float(value)
    return np.longdouble(top) + np.longdouble(float(value - Fraction(top)))


class Whitener(NamedTuple):
    """What projects: components as columns, those without spread as columns of not-a-numbers."""

    width: int
    about: Centre
    unit: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.about.n) @ (self.unit / np.sqrt(self.values))


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct x once, as a shared table, and the length of the longest. rows: x, all of one length."""
    fit = write_shared(rows.select("x").distinct(), "fit-list")
    return fit, fit.agg(F.max(F.size("x"))).first()[0] or 0


def fitted(fit: DataFrame, width: int, most: int) -> Whitener:
    """The first ``most`` components of a fit list that is not empty."""
    about = centre(fit, width)
    m = scatter(fit, width, about)
    cube, trace = about.n**3, sum(int(m[i, i]) for i in range(width))
    v = np.array([[_extended(Fraction(int(x), cube)) for x in row] for row in m], np.longdouble).reshape(width, width)
    values, unit = (part[..., :most].astype(np.float64) for part in eigen(v))
    spread = (np.arange(len(values)) < rank(m)) & (values > 0)
    explained = np.where(spread, values, 0) / float(Fraction(trace, cube)) if trace else np.full(len(values), np.nan)
    return Whitener(width, about, unit, np.where(spread, values, np.nan), explained)


def identity_error(fit: DataFrame, by: Whitener) -> float | None:
    """The largest entry by which the covariance of the projected fit list differs from the identity (components with spread; none: None)."""
    k = len(by.values)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))  # the last row adds up the values themselves
        for x in _blocks(batches, 0, by.width):
            z = by.whitened(by.about.deviations(x))
            total += np.vstack([z.T @ z, z.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "total": total.ravel()})

    sums = np.zeros((k + 1, k))
    for i, j, total in fit.mapInArrow(multiply, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        sums[i, j] = total / by.about.n
    left = np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k))
    good = ~np.isnan(by.values)
    return float(left[good][:, good].max()) if good.any() else None


def squares(y: np.ndarray) -> pa.Array:
    """The sum of squares of each row, as a long; null beyond it."""
    if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < LONG:
        y = y.astype(np.int64)
        return pa.array(np.einsum("ij,ij->i", y, y))
    sums = (y.astype(object) ** 2).sum(axis=1) if y.shape[1] else np.zeros(len(y), object)
    return pa.array([int(s) if s < LONG else None for s in sums], pa.int64())


def whiten(vectors: DataFrame, vec_id: str, vector: str, scale: float = 64.0, shift: int = 1_000_000, most: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: every remaining row with each of the first ``most`` components."""
    spark = vectors.sparkSession
    rows = whole(vectors, vec_id, vector, scale, shift)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if not longest:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(longest) - F.size("x"))))
    fit, width = fit_list(rows)
    by = fitted(fit, width, most)
    error = identity_error(fit, by)
    k = len(by.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            y = by.about.deviations(matrix(batch.column(1), width))
            m = len(y)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, by.about.n)),
                    squares(y).take(each),
                    pa.array(by.whitened(y).ravel(), from_pandas=True),
                    pa.array(np.tile(by.explained, m), from_pandas=True),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
