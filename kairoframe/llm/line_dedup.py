"""Line dedup: lines whose key occurs in many documents are dropped everywhere.

Every document gives one row per distinct line key: its hash and the key's positions. The rows are range-partitioned by (hash, document) and
sorted, so that a partition streams runs of one hash: the documents of a run are counted as they pass, a run that reaches the threshold
goes out as dropped positions, any other is forgotten. A hash with very many documents spreads over many partitions; what its fragments
lack is settled by boundary records: each partition reports its first and last run with their counts, and the rows of at most
threshold - 1 documents of each. The result is a compressed bitmap of kept lines per document, not text.

A document is what has one id: rows that share an id count once, whatever their texts, and each is treated by its own lines. A row with a null id is a
document known by its text. Ids may be of any type. Lines are split at \\n; null or empty text is one empty line. Keys are taken whole: stripped of
[\\x20\\x09-\\x0D] at both ends, A-Z lower-cased, then hashed to 64 bits; texts and lines may be of any length below 2 GB. Keys shorter than least_chars
code points are always kept. Nothing depends on how ties are broken: a key's documents all lose it. Further columns, whatever their names, are ignored,
and kept where a function returns all columns. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import LOWER, RangeHash, slices, text_bytes, words
from kairoframe.llm.storage import bounded_batches, write_shared
from kairoframe.llm.tables import number, unused

LINES = "doc_id long, version long, hash long, n_lines int, at binary"
SLICE = 1 << 20


def version(text: Column) -> Column:
    """Tells apart the texts of one id, and all texts without one."""
    return F.xxhash64(text.isNull(), text)


def line_keys(raw: np.ndarray, offsets: np.ndarray, least_chars: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: its text's number, its key's hash, and whether the key is long enough to be dropped."""
    n_texts = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    owner_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    n_lines = np.bincount(owner_of_break, minlength=n_texts) + 1
    text = np.repeat(np.arange(n_texts), n_lines)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # The k-th line of a text ends at its k-th break, the last one at the text's end.
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    start, stop, _ = words(raw, offsets)
    first = np.searchsorted(start, begin, side="left")
    last = np.searchsorted(start, end, side="left") - 1
    full = last >= first
    key_start = np.where(full, start[np.minimum(first, max(len(start) - 1, 0))] if len(start) else 0, 0)
    key_end = np.where(full, stop[np.maximum(last, 0)] if len(stop) else 0, 0)
    hashes = RangeHash(LOWER[raw])(key_start, key_end)
    if least_chars > 1:
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        full &= chars[key_end] - chars[key_start] >= least_chars
    return text, hashes, full


def _line_rows(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in slices(b, "text", SLICE)):
        raw, offsets = text_bytes(batch.column(2))
        text, hashes, full = line_keys(raw, offsets, least_chars)
        n_lines = np.bincount(text, minlength=batch.num_rows).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(n_lines)])
        at = np.flatnonzero(full)
        order = at[np.lexsort((at, hashes[at], text[at]))]
        t, h = text[order], hashes[order].view(np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        positions = (order - first[t]).astype("<u4")
        bounds = np.concatenate([np.flatnonzero(new), [len(order)]]).astype(np.int32)
        runs = bounds[:-1]
        binary = pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(positions.tobytes())])
        rows = pa.array(t[runs])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h[runs]), pa.array(n_lines[t[runs]]), binary],
            names=["doc_id", "version", "hash", "n_lines", "at"],
        )


RUNS = LINES + ", boundary boolean, n_docs long"


def _runs(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Streams sorted line rows. Rows out: those to be dropped (boundary false); of a partition's first and last run, its count
    (boundary true, n_docs, no document) and, below the threshold, its rows (boundary true, n_docs 0). All rows of a hash and a document are in
    one partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("hash", pa.int64()), ("n_lines", pa.int32()), ("at", pa.binary()), ("boundary", pa.bool_()), ("n_docs", pa.int64())])

    def out(rows: pa.Table, boundary: bool) -> list[pa.RecordBatch]:
        n = len(rows)
        return rows.append_column("boundary", pa.array(np.full(n, boundary))).append_column("n_docs", pa.array(np.zeros(n, np.int64))).cast(schema).to_batches()

    def count(value: int, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None], f.type) if f.name not in ("hash", "boundary", "n_docs") else pa.array([{"hash": value, "boundary": True, "n_docs": n}[f.name]], f.type) for f in schema], schema=schema)

    open_rows: pa.Table | None = None  # of the run that is not closed yet; none once it has reached the threshold
    open_hash = last = None
    n_open, first_run = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(2).to_numpy(zero_copy_only=False)
        nameless, doc = batch.column(0).is_null().to_numpy(zero_copy_only=False), pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
        here = (h, nameless, doc, batch.column(1).to_numpy(zero_copy_only=False))
        changed = [np.concatenate([[last is None or c[0] != last[i]], c[1:] != c[:-1]]) for i, c in enumerate(here)]
        last = tuple(c[-1] for c in here)
        fresh = changed[0] | changed[1] | changed[2] | (nameless & changed[3])  # another document
        new = fresh | changed[3]
        rows = pa.Table.from_batches([batch]).filter(pa.array(new))
        h, fresh = h[new], fresh[new]
        if not len(h):
            continue
        starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        ends = np.append(starts[1:], len(h))
        n_docs = np.add.reduceat(fresh.astype(np.int64), starts)
        big = n_docs >= threshold
        # The first run here continues the open one, or is the partition's first.
        rest = int(open_hash is None or h[0] == open_hash)
        if rest:
            reached = n_open >= threshold
            open_hash, n_open, mine = int(h[0]), n_open + int(n_docs[0]), rows.slice(0, ends[0])
            if reached:
                yield from out(mine, False)
            else:
                open_rows = pa.concat_tables([open_rows, mine]) if open_rows is not None else mine
        if rest and n_open >= threshold and open_rows is not None:
            yield from out(open_rows, False)
            open_rows = None
        if rest < len(starts):  # other runs follow: the open one is closed
            if first_run:
                yield count(open_hash, n_open)
                if open_rows is not None:
                    yield from out(open_rows, True)
            first_run = False
            closed = np.zeros(len(h), bool)
            for i in np.flatnonzero(big[rest:-1]) + rest:
                closed[starts[i] : ends[i]] = True
            if closed.any():
                yield from out(rows.filter(pa.array(closed)), False)
            s, e = int(starts[-1]), int(ends[-1])
            open_hash, n_open, open_rows = int(h[s]), int(n_docs[-1]), rows.slice(s, e - s)
            if n_open >= threshold:
                yield from out(open_rows, False)
                open_rows = None
    if open_hash is not None:
        yield count(open_hash, n_open)
        if open_rows is not None:
            yield from out(open_rows, True)


def keep_bitmaps(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 10, least_chars: int = 1) -> DataFrame:
    """doc_id, version, n_lines, n_dropped, keep (bitmap, zlib) of the documents that lose a line; all others keep every line."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(number(documents, doc_id).alias("doc_id"), version(F.col(text)).alias("version"), F.col(text).alias("text"))
    lines = docs.mapInArrow(lambda batches: _line_rows(batches, least_chars), LINES)
    dealt = lines.repartitionByRange("hash", "doc_id", F.when(F.col("doc_id").isNull(), F.col("version"))).sortWithinPartitions("hash", "doc_id", "version")
    runs = write_shared(dealt.mapInArrow(lambda batches: _runs(batches, threshold), RUNS), "line-runs")
    settled = runs.where("NOT boundary").select("doc_id", "version", "n_lines", "at")
    edges = runs.where("boundary")  # those of at most 2 x threshold documents a partition
    hot = edges.where("n_docs > 0").groupBy("hash").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= threshold).select("hash")
    late = edges.where("n_docs = 0").join(hot, "hash", "left_semi").select("doc_id", "version", "n_lines", "at")
    dropped = settled.unionByName(late).groupBy("doc_id", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_list("at").alias("at"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n = [], []
            for n_lines, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n_lines, bool)
                keep[np.frombuffer(b"".join(at), "<u4")] = False
                kept.append(zlib.compress(np.packbits(keep).tobytes(), 1))
                n.append(n_lines - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int32()), pa.array(kept, pa.binary())], names=["doc_id", "version", "n_lines", "n_dropped", "keep"])

    return dropped.mapInArrow(bitmaps, "doc_id long, version long, n_lines int, n_dropped int, keep binary")


def with_bitmaps(documents: DataFrame, bitmaps: DataFrame, keep: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of documents, and their bitmap in the column ``keep`` (null: every line stays)."""
    id_, version_ = (unused(documents.columns, c) for c in ("__id", "__version"))
    right = bitmaps.select(F.col("doc_id").alias(id_), F.col("version").alias(version_), F.col("keep").alias(keep))
    same = number(documents, doc_id).eqNullSafe(F.col(id_)) & (version(F.col(text)) == F.col(version_))
    return documents.join(right, same, "left").drop(id_, version_)


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], int]:
    """The lines that stay, and the number of lines before."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [line for line, bit in zip(lines, bits) if bit], len(lines)


def digests(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents (doc_id, text)."""
    joined = with_bitmaps(documents.select("doc_id", "text"), bitmaps, "keep")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, sha = [], [], []
            for text, keep in zip(batch.column(1), batch.column(2).to_pylist()):
                if keep is None:
                    raw = text.as_buffer() if text.is_valid else b""
                    lines = pc.count_substring(text, "\n").as_py() + 1 if text.is_valid else 1
                    n.append(lines)
                    dropped.append(0)
                    sha.append(hashlib.sha256(raw).hexdigest())
                else:
                    kept, lines = kept_lines(text.as_py(), keep)
                    n.append(lines)
                    dropped.append(lines - len(kept))
                    sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(digest, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(documents: DataFrame, threshold: int = 10, least_chars: int = 1) -> DataFrame:
    """documents, all columns, with their repeated lines taken out of text (and n_chars, where there is one, counted again)."""
    columns = documents.columns
    keep = unused(columns, "__keep")
    joined = with_bitmaps(documents, keep_bitmaps(documents, threshold=threshold, least_chars=least_chars), keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if k is None else "\n".join(kept_lines(t, k)[0]) for t, k in zip(batch.column("text").to_pylist(), batch.column(keep).to_pylist())]
            i = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == i else batch.column(j) for j in range(len(columns))], names=columns)

    kept = joined.select(*columns, keep).mapInArrow(apply, documents.schema)
    return kept.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in columns else kept
