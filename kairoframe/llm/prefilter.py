"""Keep text out of shuffles: a Bloom filter of the ids that a join needs, sent around if its size is within a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import mix
from kairoframe.llm.url_filter import Bloom


def _keys(ids: np.ndarray) -> np.ndarray:
    ids = ids.astype(np.int64).view(np.uint64)
    return np.stack([mix(ids), mix(ids ^ np.uint64(0xA24BAED4963EE407))], axis=1)


def filter_of(ids: DataFrame, most_mb: int = 64) -> Bloom | None:
    """A filter of the column ``doc_id``, distinct longs; None if it would take more than most_mb. Its bits are OR-ed on the executors."""
    n_words, hashes = Bloom.shape(max(1, ids.count()), 0.01)
    if n_words * 8 > most_mb << 20:
        return None

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Bloom.positions(0, hashes, n_words, _keys(batch.column(0).to_numpy(zero_copy_only=False))).ravel()
            yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = ids.select("doc_id").mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(n_words, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bloom(0, hashes, bits)


def passing(rows: DataFrame, bloom: Bloom | None, inside: bool = True) -> DataFrame:
    """The rows (first column: a long id, never null) that the filter passes, or those that it doesn't. Without a filter all pass."""
    if bloom is None:
        return rows if inside else rows.where(F.lit(False))
    sent = rows.sparkSession.sparkContext.broadcast(bloom)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):  # only so many texts are copied at a time
            if batch.num_rows:
                yield batch.filter(pa.array(sent.value.has(_keys(batch.column(0).to_numpy(zero_copy_only=False))) == inside))

    return rows.mapInArrow(check, rows.schema)
