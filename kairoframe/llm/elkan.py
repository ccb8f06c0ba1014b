"""Exact k-means on whole numbers with Elkan's bounds.

Vectors are packed into slabs, rows of up to ``slab`` vectors, in the partitions that they are read in; nothing but sums is ever shuffled. With each vector a slab
keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to every centroid. A round reads the slabs, is sent the k centroids, their distances from each
other and how far each has moved, and writes the slabs anew with the sums of each cluster, which are added up over slabs, tasks and the cluster. So a lost executor costs its tasks' slabs, and the
driver holds k vectors.

A centroid is skipped for a vector only if the upper bound is strictly below its lower bound, or strictly below half of the distance between the centroids: then it is strictly farther
away. Bounds are float32, rounded away from the distance, so rounding never skips what could tie; whatever is not skipped is compared by exact squared distances, ties to the smaller
number.

Cases: rows whose vector is null, or holds a null or non-finite entry, or has another length, are left out. Each row is a vector, also one given twice or with the id of another; centroids start
in the order of hash, then vector; rows with a null id are clustered but start none, and with no others there are no centroids and all other columns are null. With fewer vectors
than k there are so many centroids. A cluster that loses all its vectors keeps its centroid. An empty table gives an empty result. Squared distances have to fit into a long: larger entries
are an error. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.storage import drop_shared, write_shared
from kairoframe.llm.vectors import matrix, whole

SLAB = "ids array<{kind}>, item int, cells binary"
STATE = ", near binary, upper binary, lower binary, sums binary, counts binary, computed long"


def below(x: np.ndarray) -> np.ndarray:
    """float32 numbers that are smaller."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of longs."""
    off = a - b
    return np.einsum("...j,...j->...", off, off)


class Centres(NamedTuple):
    """What a round is sent: the centroids, less than half of their distances from each other, and more than each has moved by."""

    at: np.ndarray
    half: np.ndarray
    moved: np.ndarray


def centres(at: np.ndarray, before: np.ndarray) -> Centres:
    half = below(np.sqrt(squared(at[:, None], at[None, :]).astype(np.float64)) / 2)
    np.fill_diagonal(half, np.inf)
    return Centres(at, half, above(np.sqrt(squared(at, before).astype(np.float64))))


class Bounds(NamedTuple):
    """Of each vector: its centroid, and what is not below and not above its distances."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def unbounded(n: int, k: int) -> Bounds:
    return Bounds(np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32))


def assigned(x: np.ndarray, old: Bounds, by: Centres) -> tuple[Bounds, int]:
    """The nearest centroids, new bounds, and how many distances it took."""
    near = old.near.copy()
    lower = np.maximum(below(old.lower.astype(np.float64) - by.moved), np.float32(0))
    upper = above(old.upper.astype(np.float64) + by.moved[near])
    open_ = np.flatnonzero(~(upper < by.half.min(axis=1)[near]))
    best = squared(x[open_], by.at[near[open_]])
    computed = len(open_)
    root = np.sqrt(best.astype(np.float64))
    upper[open_], lower[open_, near[open_]] = above(root), np.maximum(below(root), np.float32(0))
    for c in range(len(by.at)):
        now, reach = near[open_], upper[open_]
        left = np.flatnonzero((now != c) & ~(reach < lower[open_, c]) & ~(reach < by.half[now, c]))
        rows = open_[left]
        d = squared(x[rows], by.at[c])
        computed += len(rows)
        root = np.sqrt(d.astype(np.float64))
        lower[rows, c] = np.maximum(below(root), np.float32(0))
        wins = (d < best[left]) | ((d == best[left]) & (c < near[rows]))
        near[rows[wins]], upper[rows[wins]], best[left[wins]] = c, above(root[wins]), d[wins]
    return Bounds(near, upper, lower), computed


def packed(rows: DataFrame, width: int, slab: int) -> DataFrame:
    """rows: vec_id, x. Slabs of up to ``slab`` rows of a partition, in the smallest whole-number type that holds them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, slab) for b in batches for a in range(0, b.num_rows, slab)):
            x, ids = matrix(batch.column(1), width), batch.column(0)
            kind = np.min_scalar_type(-int(np.abs(x).max(initial=0)) - 1)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([lists, pa.array([kind.itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()])], names=["ids", "item", "cells"])

    return rows.mapInArrow(pack, SLAB.format(kind=rows.schema["vec_id"].dataType.simpleString()))


class Slab(NamedTuple):
    ids: pa.Array
    x: np.ndarray
    bounds: Bounds


def _slabs(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[tuple[pa.RecordBatch, Slab]]:
    """Each row of the slabs' table, and what it holds."""
    for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        raw = {c: row.column(c)[0].as_buffer() for c in ("cells", "near", "upper", "lower") if c in row.schema.names}
        x = np.frombuffer(raw["cells"], f"i{row.column('item')[0].as_py()}").astype(np.int64).reshape(-1, width)
        old = Bounds(np.frombuffer(raw["near"], np.int32), np.frombuffer(raw["upper"], np.float32), np.frombuffer(raw["lower"], np.float32).reshape(-1, k)) if "near" in raw else unbounded(len(x), k)
        yield row, Slab(row.column("ids")[0].values, x, old)


def reassigned(slabs: DataFrame, width: int, by: Centres) -> DataFrame:
    """The slabs after an assignment, each with its clusters' sums and counts."""
    k = len(by.at)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, slab in _slabs(batches, width, k):
            (near, upper, lower), computed = assigned(slab.x, slab.bounds, by)
            sums = np.zeros((k, width), np.int64)
            np.add.at(sums, near, slab.x)
            parts = [near, upper, lower, sums, np.bincount(near, minlength=k)]
            yield pa.RecordBatch.from_arrays(
                [*(row.column(c) for c in ("ids", "item", "cells")), *(pa.array([p.tobytes()]) for p in parts), pa.array([computed])],
                names=["ids", "item", "cells", "near", "upper", "lower", "sums", "counts", "computed"],
            )

    return slabs.mapInArrow(assign, f"ids {slabs.schema['ids'].dataType.simpleString()}, item int, cells binary{STATE}")


def replaced(slabs: DataFrame, at: np.ndarray) -> np.ndarray:
    """The centroids after an assignment: floors of means, exact; without vectors, as before."""
    k, width = at.shape

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for s, n in zip(batch.column("sums"), batch.column("counts")):
                sums, counts = sums + np.frombuffer(s.as_buffer(), np.int64).reshape(k, width), counts + np.frombuffer(n.as_buffer(), np.int64)
        cluster, entry = np.indices((k, width))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(cluster.ravel(), pa.int32()), "entry": pa.array(entry.ravel(), pa.int32()), "total": sums.ravel(), "n": np.repeat(counts, width)})

    parts = slabs.select("sums", "counts").mapInArrow(total, "cluster int, entry int, total long, n long")
    new = at.copy()
    for cluster, entry, sum_, n in parts.groupBy("cluster", "entry").agg(F.sum(F.col("total").cast("decimal(20,0)")), F.sum("n")).collect():
        if n:
            new[cluster, entry] = int(sum_) // n
    return new


def unpacked(slabs: DataFrame, width: int, at: np.ndarray, kind: str) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slab in _slabs(batches, width, len(at)):
            near = slab.bounds.near
            yield pa.RecordBatch.from_arrays([slab.ids, pa.array(near), pa.array(squared(slab.x, at[near]))], names=["vec_id", "cluster", "distance"])

    return slabs.mapInArrow(unpack, f"vec_id {kind}, cluster int, distance long")


def starts(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the k smallest hashes of seed:id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select("x").orderBy(key, "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def clustered(rows: DataFrame, width: int, at: np.ndarray, rounds: int = 3, slab: int = 4096) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Slabs with each vector's nearest centroid after so many rounds of assigning and replacing, the centroids, and how many distances each assignment took."""
    now, before, spent = write_shared(packed(rows, width, slab), "slabs"), at, []
    for i in range(rounds + 1):
        done = write_shared(reassigned(now, width, centres(at, before)), f"slabs-{i}")
        spent.append(done.agg(F.sum("computed")).first()[0] or 0)
        drop_shared(now)
        now = done
        if i < rounds:
            before, at = at, replaced(now, at)
    return now, at, spent


def clusters(vectors: DataFrame, vec_id: str, vector: str, width: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: str = "1", slab: int = 4096) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = vectors.sparkSession
    rows = whole(vectors.where(F.size(vector) == width), vec_id, vector, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    largest = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0
    if width * (2 * largest + 1) ** 2 >= 1 << 63:
        raise ValueError(f"an entry of {largest} after scaling: squared distances of {width} such entries do not fit into a long")
    at = starts(rows, k, seed)
    if not len(at):
        empty = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    slabs, at, _ = clustered(rows, width, at, rounds, slab)
    placed = write_shared(unpacked(slabs, width, at, kind), "placed")
    drop_shared(slabs)
    inertia = {c: int(d) for c, d in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}  # at most k rows
    total = sum(inertia.values())
    summed = [(c, d if d < 1 << 63 else None, total if total < 1 << 63 else None, hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    by_cluster = spark.createDataFrame(summed, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
