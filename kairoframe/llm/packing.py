"""Packing: concatenate all documents' tokens and cut them every ``length`` tokens.

Two passes. The first encodes each document once and writes its ids, with the number of its partition and its place among that partition's
tokens. The partitions' token totals (one number a partition) are summed up to the offset at which each partition begins in the
whole; the second pass adds it and cuts each document at the fixed windows: a document that crosses a window's end leaves a
boundary record on either side. No shuffle, no sort; only the very last sequence is padded.

The order of documents is that of the input's partitions. A task that runs again writes the same rows, since a partition's rows
and their order are those of its input files.

Null text is empty: such a document is its end token alone. A text may be of any length below 2 GB: it is encoded at once, in memory in proportion to
it, and cut over as many sequences as it takes. Rows given twice are packed twice, in their order; so nothing depends on how ties are
broken. Ids may be of any type, null too. An empty table gives an empty result. Further columns, whatever their names, are ignored. Special tokens'
strings in a text are ordinary text.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import slices, text_bytes
from kairoframe.llm.storage import bounded_batches, write_shared

SLICE = 2 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Kinds of bytes, as bits: an ASCII letter; a space or line break; surely no white space (not ASCII's own, nor a first byte of the wide ones); an ASCII
#: character that is neither letter nor white space.
LETTER, BREAK, SOLID, MARK = 1, 2, 4, 8
_letters, _spaces = {*range(65, 91), *range(97, 123)}, {*range(9, 14), 32}
KIND = np.array(
    [LETTER * (b in _letters) | BREAK * (b in (10, 32)) | SOLID * (b not in _spaces | {0xC2, 0xE1, 0xE2, 0xE3}) | MARK * (b < 128 and b not in _letters | _spaces) for b in range(256)], np.uint8
)
#: A byte-level vocabulary writes bytes that are no printable characters as the characters from U+0100 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
PRINTABLE = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def part_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a byte-level BPE's pattern surely splits: at every text's start, at a space or line break before a character that is no white space, and
    between an ASCII letter and an ASCII character that is neither letter nor white space. Parts are encoded apart from each other."""
    n = len(raw)
    cut = np.zeros(n, bool)
    kind = KIND[raw]
    if n > 1:
        cut[:-1] = (kind[:-1] & BREAK) & (kind[1:] >> 1)
        cut[1:] |= ((kind[:-1] << 3) & kind[1:] & MARK) != 0
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts part by part. Parts are told apart a slice at a time; those that the worker has met before are looked up, so that the tokenizer
    only sees new ones."""

    def __init__(self, path: str, remembered: int = 100_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, parts: list[str]) -> None:
        """Encode new parts. The pattern takes a run of letters, with a space before it or none, as one piece: such parts go straight to the merges, in
        the bytes' printable form."""
        code, pieces, known = self.kind.char, self.tokenizer.model.tokenize, self.known
        others = []
        for p in parts:
            if p.isalpha() or (p[0] == " " and p[1:].isalpha()):
                printable = p.replace(" ", "\u0120") if p.isascii() else p.encode().decode("latin-1").translate(PRINTABLE)
                known[p] = array(code, [t.id for t in pieces(printable)]).tobytes()
            else:
                others.append(p)
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            known[p] = array(code, e.ids).tobytes()

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and the n + 1 offsets of the texts in them."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        raw, offsets = text_bytes(texts)
        start = part_starts(raw, offsets)
        bounds = np.append(start, len(raw)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        self.learn([w for w in new if w not in self.older])
        found = [self.known[w] for w in words]
        step = self.kind.itemsize
        size = np.array([len(f) // step for f in found], np.int64)
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), self.kind)
        at = parts.indices.to_numpy()
        n = size[at]
        total = np.concatenate([[0], np.cumsum(n)])
        of_text = total[np.searchsorted(start, offsets)]  # tokens before each text
        ids = np.full(int(total[-1]) + len(texts), end_id, self.kind)
        text = np.repeat(np.arange(len(texts)), np.diff(of_text))
        ids[np.arange(int(total[-1])) + text] = flat[np.repeat(first[at] - total[:-1], n) + np.arange(int(total[-1]))]
        return ids, of_text + np.arange(len(texts) + 1)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(documents: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, first (place among the partition's tokens), n_tokens, ids."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, first = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in (some for b in batches for some in slices(b, "text", SLICE)):
            ids, bounds = own(batch.column(1), end_id)
            n = np.diff(bounds)
            binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds * own.kind.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(first + bounds[:-1]), pa.array(n), binary], names=["doc_id", "part", "first", "n_tokens", "ids"])
            first += int(bounds[-1])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, part int, first long, n_tokens long, ids binary")


def pack(documents: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    bounded_batches(spark)
    table = write_shared(encoded(documents, tokenizer, end_id), "encoded")
    totals = table.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total")).orderBy("part").collect()  # a row a partition
    begins = np.zeros(1 + max((r["part"] for r in totals), default=0), np.int64)
    at = 0
    for row in totals:
        begins[row["part"]] = at
        at += row["total"]
    sent = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        for batch in batches:
            out: list[tuple[int, ...]] = []
            ids_column = batch.column(4)
            for i, (part, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 4)))):
                ids = np.frombuffer(ids_column[i].as_buffer(), kind).astype("<u4").tobytes()
                place, start = int(sent.value[part]) + first, 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(length - offset, n - start)
                    out.append((i, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, offset))
                    start += size
            row, *columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return table.select("doc_id", "part", "first", "n_tokens", "ids").mapInArrow(cut, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, {PIECES}")
