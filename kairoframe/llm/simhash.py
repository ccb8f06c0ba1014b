"""SimHash near-duplicates by meeting in the middle of Hamming balls.

1. A document's fingerprint: bit b is set if it is in over half of its shingles' XXH64 hashes, repeats counted. Documents with one fingerprint are a class; from here on
   only distinct fingerprints are handled, so a text that a third of all documents share is one.
2. Two fingerprints of at most ``radius`` differing bits have a variant in common that is within half the radius of the one, rounded down, and of the other, rounded up. Every
   fingerprint emits its variants up to the larger half (65 at a radius of 2), marked if they are within the smaller, and is shuffled to them.
3. Whoever meets at a variant is within the radius of every fingerprint that is marked there. So all are linked to the smallest marked one, which gives the components that all
   pairs would give; links are told apart, and each is verified on the fingerprints. Among distinct fingerprints a variant is met by no more than a ball holds, so no list is long.
4. Links make components (components.py); a document's is the smallest id in its component's classes.

Cases: documents without words (null text too) have the fingerprint zero, which is linked like any other; with fewer words than a shingle has, the whole sequence is the one
shingle; rows that share an id are so many texts, each with a fingerprint and a component of its own; a row without an id is returned with a null component_id and links nothing; ids
of other types than whole numbers are an error; texts may be of any length below 2 GB. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import LOWER, SPACE, slices, text_bytes
from kairoframe.llm.components import connected_components
from kairoframe.llm.storage import bounded_batches, write_shared

SLICE = 1 << 20
PART = 1 << 15  # hashes whose bits are counted at a time
SALTS = 16


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z lower-cased, with one space after each; where each starts and ends, and how many each text has."""
    solid = ~SPACE[raw]
    last = np.zeros(len(raw), bool)  # a text's last byte ends a word without a space
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | last[:-1]
    # Each byte of a word is kept, and where one ends a space is put in.
    width = solid.astype(np.int64) + ends
    out = np.full(int(width.sum()), 0x20, np.uint8)
    place = np.cumsum(width) - width
    out[place[solid]] = LOWER[raw[solid]]
    at = np.flatnonzero(ends)
    end = place[at] + 1
    start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    return out.tobytes(), start, end, np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=len(offsets) - 1)


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text."""
    from xxhash import xxh64_intdigest

    line, start, end, count = spaced(raw, offsets)
    n_out = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), n_out)
    first = np.concatenate([[0], np.cumsum(count)])
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    left, right = start[at], end[at + np.minimum(count, size)[owner] - 1]
    bits = np.zeros((len(count), 64), np.int64)
    for a in range(0, len(owner), PART):
        hashes = np.array([xxh64_intdigest(line[i:j], 42) for i, j in zip(left[a : a + PART].tolist(), right[a : a + PART].tolist())], np.uint64)
        of = owner[a : a + PART]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits[of[cuts]] += np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * bits > n_out[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(documents: DataFrame, size: int) -> DataFrame:
    """documents: doc_id, text. doc_id and fp, a long with the fingerprint's bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(*text_bytes(batch.column(1)), size).view(np.int64))], names=["doc_id", "fp"])

    return documents.mapInArrow(sign, "doc_id long, fp long")


def ball(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of up to half the radius, rounded up, bits; and which of them have no more than half of it, rounded down."""
    masks = [sum(1 << b for b in bits) for n in range(-(-radius // 2) + 1) for bits in combinations(range(64), n)]
    return np.array(masks, np.uint64), np.array([m.bit_count() <= radius // 2 for m in masks])


def variants(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct: fp. variant, fp, inner (whether it is within the smaller half of the radius)."""
    masks, inner = ball(radius)
    step = max(1, (1 << 18) // len(masks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"variant": (fp[:, None] ^ masks).ravel().view(np.int64), "fp": np.repeat(fp.view(np.int64), len(masks)), "inner": np.tile(inner, len(fp))})

    return distinct.mapInArrow(emit, "variant long, fp long, inner boolean")


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """a, b: pairs of distinct fingerprints of at most ``radius`` differing bits, each once, whose components are those of all such pairs."""
    met = Window.partitionBy("variant")
    centred = variants(distinct, radius).withColumn("b", F.min(F.when(F.col("inner"), F.col("fp"))).over(met))
    found = centred.where(F.col("fp") != F.col("b")).select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b")).distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    bounded_batches(documents.sparkSession)
    signed = write_shared(fingerprints(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), size), "fingerprints")
    classes = write_shared(signed.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), radius), "a", "b")
    rooted = write_shared(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # A class may hold a third of all rows: they are dealt out, and its row copied to each part.
    parts = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = signed.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    joined = salted.join(parts, ["fp", "salt"], "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
