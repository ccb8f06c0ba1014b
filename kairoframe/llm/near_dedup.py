"""Near-duplicate documents by bottom-k sketches of one hash function, inverted lists, union-sketch estimates and exact Jaccard.

1. A document's set is its distinct word shingles, as 64-bit hashes; its sketch the ``SKETCH`` smallest of them. Documents with equal sets
   form a class; from here on only one representative of each class is handled.
2. Inverted lists: representatives by retained value. Two sets of similarity t share a binomial number of sketch values, SKETCH x t
   expected, and fewer than needed(t) with a chance below 1e-7. Hence, with values in order of rarity, the first SKETCH - needed(t) + 1 of both
   sketches share one (a pigeonhole argument), and a value that occurs once needs no list. An ordinary document's rarest values are all its own, so it
   enters no list at all.
3. Short lists yield all their pairs; every pair passes a union-sketch estimate, then the exact Jaccard of the full sets.
   Long lists, of values in many copies of something, yield no pairs. Their documents are put into blocks, copies of one thing into the same
   blocks, and each two blocks that share a long list's value are compared once, in one task: sketch overlaps, then
   exact intersections, as matrix products; a block travels as one row. A task returns a spanning forest of the links it finds, at most one row a document.
4. Links make components (components.py). The graph's nodes are class representatives, and a class's members follow theirs.

No list, block or partner is capped. Cases: documents without words (null text too) have an empty set and are linked with nothing; a text with
fewer words than the shingle has one shingle, all its words; rows that share an id count as one document; a row without an id is returned with
null component_id and kept, and links nothing; ids are whole numbers (for others the cast fails); texts may be of any length below 2 GB; the smallest id of a
component is kept. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import mix, shingles, slices, text_bytes
from kairoframe.llm.components import connected_components
from kairoframe.llm.prefilter import filter_of, passing
from kairoframe.llm.storage import bounded_batches, write_shared

SKETCH = 64
SHORT = 64  # documents in a list that is expanded into pairs
BLOCK = 256  # documents, or BLOCK_MB of their sets
BLOCK_MB = 8
SLICE = 1 << 20
SIGNATURES = "doc_id long, n int, one long, two long, sketch binary"


def needed(percent: int) -> int:
    """The most sketch values that two sets of this similarity share fewer of with a chance below 1e-7. Sketches of smaller sets are whole
    sets, or nearly so, and share far more than the third that is asked of them."""
    t, below = percent / 100, 0.0
    for k in range(SKETCH + 1):
        below += comb(SKETCH, k) * t**k * (1 - t) ** (SKETCH - k)
        if below >= 1e-7:
            return k
    return SKETCH


def distinct_shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct shingle hashes in ascending order, and their n + 1 offsets."""
    value, out = shingles(raw, offsets, size)
    text = np.repeat(np.arange(len(out) - 1), np.diff(out))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(out)))


def _binary(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """values[first:last] of each row as bytes."""
    raw = np.ascontiguousarray(values).tobytes()
    return pa.array([raw[8 * a : 8 * b] for a, b in zip(first.tolist(), last.tolist())], pa.binary())


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """documents: doc_id, text. Two fingerprints of the set, its size and its sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            value, out = distinct_shingles(*text_bytes(batch.column(1)), size)
            n = np.diff(out)
            totals = [np.concatenate([[np.uint64(0)], np.cumsum(v)]) for v in (mix(value ^ np.uint64(0x5851F42D4C957F2D)), mix(value + np.uint64(0x14057B7EF767814F)))]
            one, two = (t[out[1:]] - t[out[:-1]] for t in totals)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(value, out[:-1], np.minimum(out[1:], out[:-1] + SKETCH))],
                names=["doc_id", "n", "one", "two", "sketch"],
            )

    return documents.mapInArrow(sign, SIGNATURES)


def full_sets(documents: DataFrame, size: int) -> DataFrame:
    """documents: doc_id, text. doc_id and ``values``, the whole set as bytes."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            value, out = distinct_shingles(*text_bytes(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(value, out[:-1], out[1:])], names=["doc_id", "values"])

    return documents.mapInArrow(take, "doc_id long, values binary")


def exploded(sketches: DataFrame) -> DataFrame:
    """doc_id, value of every sketch value."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            owner = pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["doc_id", "value"])

    return sketches.select("doc_id", "sketch").mapInArrow(spread, "doc_id long, value long")


def list_entries(sketches: DataFrame, percent: int) -> DataFrame:
    """doc_id, value, df of the values under which a document is listed: the rarest, without those that it alone has."""
    entries = exploded(sketches).repartition("value")
    shared = entries.join(entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value")
    per_doc = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("df", "value"))).alias("values"))
    kept = sketches.select("doc_id", (F.octet_length("sketch") / 8).cast("int").alias("kept")).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    need = F.when(F.col("kept") >= SKETCH, F.lit(needed(percent))).otherwise(F.greatest(F.lit(1), F.floor(F.col("kept") / 3).cast("int")))
    first = F.col("kept") - need + 1 - (F.col("kept") - F.size("values"))
    listed = per_doc.join(kept, "doc_id").withColumn("first", first).where("first > 0")
    return listed.select("doc_id", F.explode(F.slice("values", F.lit(1), F.col("first"))).alias("e")).select("doc_id", "e.df", "e.value")


def cold_pairs(entries: DataFrame) -> DataFrame:
    """a < b: the documents that share a short list, each pair once."""
    lists = entries.where(F.col("df") <= SHORT).groupBy("value").agg(F.array_sort(F.collect_set("doc_id")).alias("ids")).where(F.size("ids") > 1)
    first = lists.select("ids", F.posexplode("ids").alias("i", "a"))
    return first.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b")).distinct()


def estimated(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs whose union-sketch estimate is at least ``least``."""
    one = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                twice = both[1:] == both[:-1]
                union = len(both) - int(twice.sum())
                k = min(SKETCH, union)
                # The k smallest values of the union, and how many of them are in both sketches.
                new = np.concatenate([[True], ~twice])
                rank = np.cumsum(new)[1:]
                good[i] = int((twice & (rank <= k)).sum()) >= least * k
            yield batch.filter(pa.array(good)).select(["a", "b"])

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(judge, "a long, b long")


def similar(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("doc_id").alias("a"), F.col("values").alias("va"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("values").alias("vb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    good[i] = similar(np.int64((x[at] == y).sum()), np.int64(len(x)), np.int64(len(y)), percent)
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(judge, "a long, b long")


def hot_blocks(entries: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, block) of the documents in long lists, and (left, right), left <= right, of the blocks that share such a list's value.
    sizes: doc_id, n (of its set).

    A document's home is the most frequent value that it is listed under; copies of one thing have few homes. A home's documents are dealt
    out to blocks of about BLOCK documents or BLOCK_MB by a hash."""
    hot = entries.where(F.col("df") > SHORT)
    homes = hot.groupBy("doc_id").agg(F.max(F.struct("df", "value")).alias("top")).select("doc_id", F.col("top.value").alias("home"))
    filled = homes.join(sizes, "doc_id").groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / (BLOCK_MB << 20))).alias("cells"))
    cell = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")
    placed = write_shared(homes.join(filled, "home").select("doc_id", F.xxhash64("home", cell).alias("block")), "blocks")
    lists = hot.join(placed, "doc_id").select("value", "block").distinct()
    meet = lists.groupBy("value").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    first = meet.select("blocks", F.posexplode("blocks").alias("i", "left"))
    return placed, first.select("left", F.explode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("right")).distinct()


def _overlap(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the two incidence matrices, some columns at a time."""
    value = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in (*sets, *others)])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # values of one set add nothing
    column, owner = column[often], owner[often]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    total = np.zeros((len(sets), len(others)), np.int64)
    step = 4096
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + step, step))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        grid = np.zeros((len(sets) + len(others), step), np.float32)
        grid[owner[a:b], column[a:b] - i * step] = 1
        total += np.rint(grid[: len(sets)] @ grid[len(sets) :].T).astype(np.int64)
    return total


def forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Which of the edges a spanning forest needs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(i)
    return kept


def hot_links(placed: DataFrame, meets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning forests of the links between the documents of blocks that meet. A block is one row, its documents and their sets."""
    blocks = sets.join(placed, "doc_id").groupBy("block").agg(F.collect_list(F.struct("doc_id", "values")).alias("rows"))
    blocks = write_shared(blocks, "filled-blocks")
    one, two = (blocks.select(F.col("block").alias(side), F.col("rows").alias(f"{side}_rows")) for side in ("left", "right"))
    need = needed(percent)

    def unpacked(rows: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, values = rows.field(0).to_numpy(), rows.field(1)
        return ids, [np.frombuffer(values[i].as_buffer(), np.uint64) for i in range(len(ids))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (i, x), (j, y) = (unpacked(batch.column(c)[row].values) for c in (0, 1))
                sketched = _overlap([v[:SKETCH] for v in x], [v[:SKETCH] for v in y])
                n, m = np.array([len(v) for v in x]), np.array([len(v) for v in y])
                kept = np.minimum(np.minimum(n[:, None], m[None, :]), SKETCH)
                maybe = sketched >= np.where(kept >= SKETCH, need, np.maximum(1, kept // 3))
                rows_, columns_ = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
                if not len(rows_):
                    continue
                common = _overlap([x[r] for r in rows_], [y[c] for c in columns_])
                r, c = np.nonzero(similar(common, n[rows_][:, None], m[columns_][None, :], percent))
                a, b = i[rows_[r]], j[columns_[c]]
                kept_edges = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[kept_edges]), pa.array(b[kept_edges])], names=["a", "b"])

    return meets.join(one, "left").join(two, "right").select("left_rows", "right_rows").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. percent: the least Jaccard similarity of a link, in hundredths (80 or more)."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = write_shared(signatures(docs, size), "signatures")
    # The representative of a class is its smallest id, with the sketch that comes along.
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "sketch")).alias("rep"))
    classes = write_shared(classes.select("n", "one", "two", F.col("rep.doc_id").alias("rep"), F.col("rep.sketch").alias("sketch")), "classes")
    sketches = classes.select(F.col("rep").alias("doc_id"), "sketch")
    entries = write_shared(list_entries(sketches, percent), "list-entries")
    pairs = write_shared(estimated(cold_pairs(entries), sketches, needed(percent) / SKETCH), "pairs")
    placed, meets = hot_blocks(entries, classes.select(F.col("rep").alias("doc_id"), "n"))
    wanted = write_shared(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(placed.select("doc_id")).distinct(), "wanted")
    texts = passing(docs.where("doc_id IS NOT NULL"), filter_of(wanted)).join(wanted, "doc_id", "left_semi")
    sets = write_shared(full_sets(texts, size).distinct(), "sets")
    links = verified(pairs, sets, percent).unionByName(hot_links(placed, meets, sets, percent))
    roots = connected_components(links, "a", "b")
    rooted = classes.drop("sketch").join(roots, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("root", "rep").alias("root"))
    named = signed.select("doc_id", "n", "one", "two").join(rooted, ["n", "one", "two"], "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents, all columns: one document of each component, that with the smallest id; documents without an id stay."""
    gone = near_duplicates(documents, size=size, percent=percent).where("NOT kept").select("doc_id").distinct()
    kept = documents.join(gone, documents["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    return kept.select(*documents.columns)
