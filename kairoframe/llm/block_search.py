"""Exact top-k search by inner product, block at a time.

Vectors are range-partitioned by id and packed into spans, forward indexes of ``span`` rows (ids and a dense matrix) cut into blocks, ranges of ``block``
ids. Stored with a span are its blocks' maxima and minima of each dimension (term). For a query, the sum over its terms of the larger of value x maximum
and value x minimum bounds every score in the block.

Queries come in rounds of at most ``chunk``, which are broadcast: a bounded array, with each query's threshold. A threshold is the k-th best score that is
known of a query: it starts from the scores among the round's first queries, which are rows of the table as well, and rises as a task goes on from
span to span. In a span, blocks are taken in falling order of their bounds, and of a block only the queries are scored whose bound is not below their
threshold (one that equals it may still hold a tie with a smaller id). So no span is shuffled or copied, a round is one scan of the spans, and a task
returns for each query at most k candidates that reach its threshold. A ranking per query merges them.

Cases: vectors that are null, or hold a null or non-finite component, take no part, neither as queries nor as candidates; shorter
vectors count as padded with zeros; a row given twice counts once; equal scores go to the smaller id; a query without other rows
has no result; an empty table gives an empty result. A null id takes no part. Components have to stay below 2^62 after scaling, and scores below 2^63.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.llm.storage import drop_shared, new_path, write_shared

PACK = "span long, ids binary, width int, cells binary, low binary, high binary"
SEED = 4096  # queries of a round that thresholds start from


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """vec_id and cells = floor(scale * x), for the vectors that take part."""
    cells = F.col(vector).cast("array<double>")
    finite = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(cells, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("cells")).distinct()


def packed(rows: DataFrame, span: int, block: int) -> DataFrame:
    """Pack up to span rows of (vec_id, cells) into one row, with its blocks' bounds; spans are numbered by partition and place in it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        cells: list[list[int]] = []

        def out() -> pa.RecordBatch:
            width = max(map(len, cells), default=0)
            matrix = np.zeros((len(ids), width), np.int64)
            for i, row in enumerate(cells):
                matrix[i, : len(row)] = row
            cuts = np.arange(0, len(ids), block)
            low, high = (f.reduceat(matrix, cuts, axis=0) if width else np.zeros((len(cuts), 0), np.int64) for f in (np.minimum, np.maximum))
            values = {"ids": np.array(ids, np.int64), "cells": matrix, "low": low, "high": high}
            return pa.RecordBatch.from_pydict({"span": [number], "ids": [values["ids"].tobytes()], "width": pa.array([width], pa.int32()), **{c: [values[c].tobytes()] for c in ("cells", "low", "high")}})

        for batch in batches:
            new_ids, new_cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(len(new_ids)):
                ids.append(new_ids[i])
                cells.append(new_cells[i])
                if len(ids) == span:
                    yield out()
                    ids, cells, number = [], [], number + 1
        if ids:
            yield out()

    return rows.mapInArrow(pack, PACK)


class Round(NamedTuple):
    """Queries, by id, and the scores that each is known to reach k times (the least of longs, if it is not)."""

    ids: np.ndarray
    matrix: np.ndarray
    least: np.ndarray


NONE = np.iinfo(np.int64).min


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed as integers; in floating point where all sums are exact in it."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    most = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def seeded(ids: np.ndarray, matrix: np.ndarray, k: int) -> Round:
    """A round whose thresholds come from the scores among its own rows."""
    some = matrix[:SEED]
    least = np.full(len(ids), NONE)
    if len(some) > k:
        for a in range(0, len(ids), 1024):
            scores = _product(matrix[a : a + 1024], some)
            scores[ids[a : a + 1024, None] == ids[None, :SEED]] = NONE
            least[a : a + 1024] = np.partition(scores, -k, axis=1)[:, -k]
    return Round(ids, matrix, least)


class Search:
    """A task's way through its spans for one round: candidates so far, and thresholds that rise with them."""

    def __init__(self, queries: Round, k: int) -> None:
        self.queries, self.k = queries, k
        self.least = queries.least.copy()
        self.found: list[np.ndarray] = []  # rows (query's place, id, score)
        self.waiting = 0
        self.scored = self.bounded = 0  # pairs of query and block: looked into, and in all

    def look(self, ids: np.ndarray, matrix: np.ndarray, low: np.ndarray, high: np.ndarray, block: int) -> None:
        q = self.queries.matrix
        bounds = _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)
        self.bounded += bounds.size
        for b in np.argsort(-bounds.max(axis=0, initial=NONE), kind="stable"):
            mine = np.flatnonzero(bounds[:, b] >= self.least)
            self.scored += len(mine)
            own_ids, rows = ids[b * block : (b + 1) * block], matrix[b * block : (b + 1) * block]
            for some in np.array_split(mine, -(-len(mine) // 8192)) if len(mine) else ():
                scores = _product(q[some], rows)
                at, of = np.nonzero((scores >= self.least[some, None]) & (own_ids[None, :] != self.queries.ids[some, None]))
                self.found.append(np.stack([some[at], own_ids[of], scores[at, of]]))
                self.waiting += len(at)
                if self.waiting > 1 << 18:
                    self.settle()

    def settle(self) -> np.ndarray:
        """Keep the k best of each query, and raise the thresholds of those that have k."""
        who, ids, scores = np.concatenate(self.found, axis=1) if self.found else np.zeros((3, 0), np.int64)
        order = np.lexsort((ids, np.bitwise_not(scores), who))
        who, ids, scores = who[order], ids[order], scores[order]
        first = np.searchsorted(who, who, side="left")
        kept = np.arange(len(who)) - first < self.k
        best = np.stack([who[kept], ids[kept], scores[kept]])
        last = np.flatnonzero((np.arange(len(who)) - first == self.k - 1))
        self.least[who[last]] = np.maximum(self.least[who[last]], scores[last])
        self.found, self.waiting = [best], 0
        return best


def _span(row: dict, block: int) -> tuple[np.ndarray, ...]:
    """ids, matrix, low, high of a packed row."""
    ids, width = np.frombuffer(row["ids"], np.int64), row["width"]
    shapes = {"cells": len(ids), "low": -(-len(ids) // block), "high": -(-len(ids) // block)}
    return ids, *(np.frombuffer(row[c], np.int64).reshape(n, width) for c, n in shapes.items())


def top_k(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5, scale: float = 256.0, span: int = 4096, chunk: int = 16_384, block: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row (is_query, a condition on vec_id)."""
    spark = vectors.sparkSession
    rows = write_shared(quantised(vectors, vec_id, vector, scale), "vectors")
    order = ["vec_id", "cells"]
    spans = write_shared(packed(rows.repartitionByRange(*order).sortWithinPartitions(*order), span, block), "spans")
    n_queries = rows.where(is_query).count()
    asked = rows.where(is_query).repartitionByRange(max(1, -(-n_queries // chunk)), *order).sortWithinPartitions(*order)
    chunks = write_shared(packed(asked, chunk, chunk), "chunks").select("span", "ids", "width", "cells")
    path = new_path(spark, "candidates")

    def search_with(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = Search(sent.value, k)
            for batch in batches:
                for i in range(batch.num_rows):
                    task.look(*_span(batch.slice(i, 1).to_pylist()[0], block), block)
                    task.settle()
            who, ids, scores = task.settle()
            yield pa.RecordBatch.from_pydict({"query_id": sent.value.ids[who], "vec_id": ids, "score": scores})

        return search

    def go(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """One round: a scan of the spans, whose candidates are appended to those of the rounds before."""
        width = max(m.shape[1] for _, m in parts)
        queries = seeded(np.concatenate([i for i, _ in parts]), np.concatenate([_widened(m, width) for _, m in parts]), k)
        sent = spark.sparkContext.broadcast(queries)
        spans.mapInArrow(search_with(sent), "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        sent.unpersist()

    held: list[tuple[np.ndarray, np.ndarray]] = []  # at most two chunks of queries
    for row in chunks.toLocalIterator():
        ids = np.frombuffer(row["ids"], np.int64)
        if held and sum(len(i) for i, _ in held) + len(ids) > chunk:
            go(held)
            held = []
        held.append((ids, np.frombuffer(row["cells"], np.int64).reshape(len(ids), row["width"])))
    if held:
        go(held)
    drop_shared(rows, chunks)
    schema = "query_id long, vec_id long, score long"
    found = spark.read.schema(schema).parquet(path) if n_queries else spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
