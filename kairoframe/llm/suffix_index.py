"""Exact substring dedup by a logarithmic family of suffix indexes.

A level of the family is a sparse suffix array: the suffixes that begin at anchors (anchors.py: every string of ``length`` bytes has one among its
first ``choice`` bytes, at the same place in equal strings), in the order of a fingerprint of their first length - choice + 1
bytes, then of a fingerprint of all bytes that the anchor's strings cover. Only equality of long prefixes matters here, so fingerprints
replace the alphabet's order. A new batch becomes level 0; as long as there is a level of its size, the two are merged into one of the next
size, in one sorted pass, in which neighbours with equal fingerprints are the long matches. Levels that stay apart are matched by a join.

A string is repeated if an equal one has the same fingerprint at its anchor. An anchor whose whole covered context is
repeated settles all its strings at once: so the inside of copies costs one row an anchor. Only contexts that match in part are
looked at string by string: their hashes meet those of the other contexts with their prefix, one of each kind.

Prefixes with very many such contexts are dealt out by the strings' hashes over all partitions and compared as sorted neighbours; nothing is
collected by key. Both ways see all strings.

Cases: null text is empty; a text shorter than ``length`` loses nothing; matches never cross documents; equal strings inside one document
count, overlapping ones too; a row given twice is a second document, a row with a null id is a document too; texts may be of any length below 2 GB.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.llm.anchors import anchors, keys
from kairoframe.llm.bytetext import RangeHash, mix, slices, text_bytes
from kairoframe.llm.prefilter import filter_of, passing
from kairoframe.llm.storage import bounded_batches, drop_shared, write_shared

SLICE = 1 << 20
HOT_BYTES = 1 << 20  # string hashes of one prefix that are compared in one task
ENTRY = "key long, context long, doc_id long, at long"


def document_key(doc_id: Column, text: Column) -> Column:
    """64 bits of id and text: texts of one id, and all texts without an id, are told apart; rows equal in both share a key."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def version(text: Column) -> Column:
    """16 bits of the text, besides the document key."""
    return F.coalesce(F.hash(text), F.lit(0)).bitwiseAND(F.lit(0xFFFF)).cast("int")


def pack(start: np.ndarray, n: np.ndarray, version: np.ndarray) -> np.ndarray:
    """start, n (below 256) and version (16 bits) in one long."""
    return start << 24 | n << 16 | version


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, at >> 16 & 0xFF, at & 0xFFFF


def entries(documents: DataFrame, length: int, choice: int) -> DataFrame:
    """documents: doc_id, version, text. The suffixes of a batch: at holds the first string's start, their number and the version."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            raw, offsets = text_bytes(batch.column(2))
            hashed = RangeHash(raw)
            a = anchors(raw, offsets, length, choice)
            key, context = keys(hashed, a, length, choice)
            of = pa.array(a.text)
            at = pack(a.low - offsets[a.text], a.high - a.low + 1, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[a.text])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(of), pa.array(at)], names=["key", "context", "doc_id", "at"])

    return documents.mapInArrow(suffixes, ENTRY)


def neighbours(rows: DataFrame, prefixes: list[list[str]]) -> DataFrame:
    """Sorts by all columns over all partitions, and adds for each list of leading columns ``same<i>``, whether a neighbour has equal ones, and
    ``edge``, whether the row is its partition's first or last."""
    names = rows.columns
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + "".join(f", same{i} boolean" for i in range(len(prefixes))) + ", edge boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose right neighbour is to come
        before: list | None = None  # whether it equals its left neighbour
        first = True

        def out(batch: pa.RecordBatch, same: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, same), pa.array(edge)], names=[*names, *(f"same{i}" for i in range(len(prefixes))), "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            columns = {c: whole.column(whole.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in dict.fromkeys(c for p in prefixes for c in p)}
            equal = [np.logical_and.reduce([columns[c][1:] == columns[c][:-1] for c in p]) for p in prefixes]
            left = [np.concatenate([[before[i] if before else False], e]) for i, e in enumerate(equal)]
            n = whole.num_rows - 1
            if n:
                edge = np.zeros(n, bool)
                edge[0] = first
                first = False
                yield out(whole.slice(0, n), [lf[:-1] | e for lf, e in zip(left, equal)], edge)
            held, before = whole.slice(n, 1), [bool(lf[-1]) for lf in left]
        if held is not None:
            yield out(held, [np.array([b]) for b in before], np.array([True]))

    return dealt.mapInArrow(scan, schema)


def settled(table: DataFrame, prefixes: list[list[str]]) -> DataFrame:
    """The rows of a written neighbours() table, whose edges (two a partition) are compared with each other across the partitions."""
    edges = table.where("edge")
    for i, p in enumerate(prefixes):
        # One row of a partition's edge run and one of the next partition's suffice: both are edges. They are two a partition, and are sent to the table.
        twice = edges.groupBy(*p).agg(F.count("*").alias("n")).where("n > 1").select(*p, F.lit(True).alias(f"also{i}"))
        table = table.join(F.broadcast(twice), p, "left").withColumn(f"same{i}", F.col(f"same{i}") | (F.col("edge") & F.coalesce(F.col(f"also{i}"), F.lit(False)))).drop(f"also{i}")
    return table


PREFIXES = [["key"], ["key", "context"]]


class Family:
    """The levels of an index, by size: level i holds about 2^i batches."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}

    def insert(self, batch: DataFrame) -> None:
        """batch: entries(). Merging writes the new level before the old ones are deleted."""
        level, merged = 0, []
        while level in self.levels:
            merged.append(self.levels.pop(level))
            level += 1
        for old in merged:
            batch = batch.unionByName(old.select("key", "context", "doc_id", "at"))
        self.levels[level] = write_shared(neighbours(batch, PREFIXES), f"level-{level}")
        for old in merged:
            drop_shared(old)

    def matches(self) -> DataFrame:
        """The suffixes whose prefix is repeated: key, context, doc_id, at, whole (the context is repeated too)."""
        found = None
        for i, level in self.levels.items():
            rows = settled(level, PREFIXES)
            for j, other in self.levels.items():
                if i != j:
                    for n, p in enumerate(PREFIXES):
                        there = other.select(*p).distinct().withColumn("there", F.lit(True))
                        rows = rows.join(there, p, "left").withColumn(f"same{n}", F.col(f"same{n}") | F.coalesce(F.col("there"), F.lit(False))).drop("there")
            rows = rows.where("same0").select("key", "context", "doc_id", "at", F.col("same1").alias("whole"))
            found = rows if found is None else found.unionByName(rows)
        return found

    def drop(self) -> None:
        for level in self.levels.values():
            drop_shared(level)


def _string_hashes(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted: key, doc_id, at, asked. The hashes of each row's strings: key, doc_id, at, asked, place (of the first string before the anchor's end),
    hashes (64 bits each)."""
    per_doc = wanted.withColumn("version", F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int")).groupBy("doc_id", "version").agg(F.collect_list(F.struct("key", "at", "asked")).alias("rows"))
    docs = passing(documents, filter_of(wanted.select("doc_id").distinct()))
    joined = docs.join(per_doc, ["doc_id", "version"]).select("doc_id", "text", "rows")

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            raw, offsets = text_bytes(batch.column(1))
            hashed = RangeHash(raw)
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            key, at, asked = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            text = np.repeat(np.arange(len(sizes)), sizes)
            start, n, _ = unpack(at)
            row = np.repeat(np.arange(len(at)), n)
            cuts = np.concatenate([[0], np.cumsum(n)])
            first = (offsets[text] + start)[row] + np.arange(len(row)) - cuts[row]
            raw8 = hashed(first, first + length).astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch.column(0).take(pa.array(text)), pa.array(at), pa.array(asked), pa.array([raw8[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())],
                names=["key", "doc_id", "at", "asked", "hashes"],
            )

    return joined.mapInArrow(hash_, "key long, doc_id long, at long, asked boolean, hashes binary")


def _spread(keys_: np.ndarray, hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the row and a 64-bit hash, with the row's key, of every string."""
    n = np.array([len(h) // 8 for h in hashes], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), mix(np.frombuffer(b"".join(hashes), "<u8") ^ mix(keys_.view(np.uint64))[row])


def _starts(doc: pa.Array, at: np.ndarray, row: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    start, _, version_ = unpack(at[row])
    return pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(pack(start + number, np.ones(len(row), np.int64), version_))], names=["doc_id", "at"])


def _cold_repeats(rows: DataFrame) -> DataFrame:
    """doc_id, at of the asked strings that another context of their prefix has too; the contexts of a prefix meet in one task."""
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            row, number, value = _spread(batch.column(0).to_numpy(), batch.column(4).to_pylist())
            order = np.argsort(value, kind="stable")
            same = value[order][1:] == value[order][:-1]
            twice = np.zeros(len(value), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            hit = np.flatnonzero(twice & batch.column(3).to_numpy(zero_copy_only=False)[row])
            return _starts(batch.column(1), batch.column(2).to_numpy(), row[hit], number[hit])

        held: pa.Table | None = None  # rows of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks()
        if held is not None:
            yield found(held)

    return dealt.mapInArrow(compare, "doc_id long, at long")


def _hot_repeats(rows: DataFrame) -> DataFrame:
    """The same for prefixes of very many contexts: string by string, as neighbours in one order over all partitions."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            if batch.num_rows:
                row, number, value = _spread(batch.column(0).to_numpy(), batch.column(4).to_pylist())
                starts = _starts(batch.column(1), batch.column(2).to_numpy(), row, number)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *starts.columns, batch.column(3).take(pa.array(row))], names=["value", "doc_id", "at", "asked"])

    strings = rows.mapInArrow(spread, "value long, doc_id long, at long, asked boolean")
    by = [["value"]]
    table = write_shared(neighbours(strings, by), "hot-strings")
    return settled(table, by).where("same0 AND asked").select("doc_id", "at")


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, choice: int = 200, batches: int = 2) -> DataFrame:
    """doc_id (document_key), version and ``at`` (list of packed starts and numbers) of the documents that hold repeated strings of
    ``length`` bytes. The documents come to the index in ``batches`` batches."""
    if not 0 < choice < min(256, length):
        raise ValueError("choice has to be below 256 and below length")
    bounded_batches(documents.sparkSession)
    docs = documents.select(document_key(F.col(doc_id), F.col(text)).alias("doc_id"), version(F.col(text)).alias("version"), F.col(text).alias("text"))
    family = Family(documents.sparkSession)
    for i in range(batches):
        # Written first: dealing rows out by range reads them twice, and a second reading of the table costs less than one of the texts.
        batch = write_shared(entries(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), length, choice), "entries")
        family.insert(batch)
        drop_shared(batch)
    found = write_shared(family.matches(), "matches")
    family.drop()
    partial = found.where("NOT whole")
    contested = partial.select("key").distinct()
    # Copies are reduced to one of each context before they are shuffled.
    kinds = write_shared(found.where("whole").groupBy("key", "context").agg(F.min(F.struct("doc_id", "at")).alias("one")), "whole-contexts")
    others = kinds.join(contested, "key", "left_semi")
    wanted = partial.select("key", "doc_id", "at", F.lit(True).alias("asked")).unionByName(others.select("key", "one.doc_id", "one.at", F.lit(False).alias("asked")))
    wanted = write_shared(wanted, "partial-matches")
    hashed = write_shared(_string_hashes(docs, wanted, length), "strings")
    strings = F.shiftright("at", 16).bitwiseAND(F.lit(0xFF))
    hot = write_shared(wanted.groupBy("key").agg(F.sum(strings * 8).alias("bytes")).where(F.col("bytes") > HOT_BYTES).select("key"), "hot-prefixes")
    cold_rows, hot_rows = hashed.join(hot, "key", "left_anti"), hashed.join(hot, "key", "left_semi")
    names = ["key", "doc_id", "at", "asked", "hashes"]
    starts = found.where("whole").select("doc_id", "at").unionByName(_cold_repeats(cold_rows.select(*names))).unionByName(_hot_repeats(hot_rows.select(*names)))
    versioned = starts.withColumn("version", F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int"))
    return versioned.groupBy("doc_id", "version").agg(F.collect_list("at").alias("at"))


def covered(at: list[int], length: int, n_bytes: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings cover."""
    start, n, _ = unpack(np.sort(np.array(at, np.int64)))
    end = np.minimum(start + n - 1 + length, n_bytes)
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist()))


def removals(documents: DataFrame, found: DataFrame, length: int = 400) -> DataFrame:
    """documents: doc_id, text; found: repeats(). doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row.

    Only texts that may hold repeated strings are shuffled to meet them."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select(document_key(F.col("doc_id"), F.col("text")).alias("key"), version(F.col("text")).alias("version"), F.col("doc_id"), F.col("text"))
    found = write_shared(found, "repeats")
    bloom = filter_of(found.select("doc_id").distinct())
    right = found.select(F.col("doc_id").alias("key"), "version", "at")
    joined = passing(docs, bloom).join(right, ["key", "version"], "left").select("doc_id", "text", "at")
    others = passing(docs, bloom, inside=False).select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("at"))
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            out = []
            for text, at in zip(batch.column(1), batch.column(2)):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                spans = covered(at.as_py(), length, len(raw)) if at.is_valid else []
                sha, last, removed = hashlib.sha256(), 0, 0
                for begin, end in spans:
                    sha.update(raw[last:begin])
                    last, removed = end, removed + end - begin
                sha.update(raw[last:])
                out.append((len(raw), removed, len(spans), sha.hexdigest(), [{"begin": b, "end": e} for b, e in spans]))
            n, removed, count, sha, spans = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()), pa.array(spans, span_type)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: bigint, end: bigint>>"
    return joined.unionByName(others).mapInArrow(digest, schema)
