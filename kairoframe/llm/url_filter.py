"""URL filters: an exact allow / block list as a cascade of Bloom filters.

Level 1 encodes the listed keys. Keys of the corpus that it passes wrongly are encoded by level 2, listed keys that level 2
passes wrongly by level 3, and so on until a level passes nothing wrongly. Over the corpus's complete key universe, which the
cascade is built from, membership is then exact, and judging a page needs neither a join nor a shuffle.

Level 1 passes so few keys wrongly (listed keys / (1.4 x other keys)) that level 2 has fewer keys than level 1, and later ones halve. So a cascade's size
follows the list, which the driver holds, times the logarithm of the corpus's keys: about 1.44 log2(1.4 x other / listed) bits a listed key. A list whose
first level would take more than ``most_mb`` is looked up by an exact join of the pages' keys instead.

A key is a host suffix with a path prefix. Only suffixes with as many labels as some rule's host, and prefixes as long as some
rule's path, can equal a rule; so a page has at most (label counts x path lengths of the rules) keys, however long its url is.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty path fits no rule whose path is
``/``; repeated pages are judged alike; of rules that fit, the longest (host and path together) wins, ties go to the longer host;
a page without a rule gets the default verdict. An empty page table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import mix
from kairoframe.llm.storage import drop_shared, write_shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


class Shape:
    """Which suffixes and prefixes can equal a rule."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        rules = list(rules)
        self.labels = sorted({r.host.count(".") + 1 for r in rules}, reverse=True)
        self.lengths = sorted({len(r.path) for r in rules}, reverse=True)

    def keys(self, host: str, path: str) -> list[tuple[str, str]]:
        """Longest first."""
        parts = host.split(".") if host else []
        suffixes = [".".join(parts[len(parts) - n :]) for n in self.labels if n <= len(parts)]
        found = [(s, path[:n]) for s in suffixes for n in self.lengths if n <= len(path)]
        return sorted(found, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))


def digest(key: tuple[str, str]) -> bytes:
    return hashlib.blake2b(f"{key[0]}\n{key[1]}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Bloom(NamedTuple):
    level: int
    hashes: int
    bits: np.ndarray  # of 64-bit words

    @staticmethod
    def shape(n: int, false_positives: float) -> tuple[int, int]:
        """Number of 64-bit words and of hash functions."""
        words = max(1, math.ceil(-n * math.log(false_positives) / math.log(2) ** 2 / 64))
        return words, max(1, round(-math.log2(false_positives)))

    @staticmethod
    def positions(level: int, hashes: int, n_words: int, keys: np.ndarray) -> np.ndarray:
        """keys: n x 2 words of 64 bits; the result: n x hashes bit positions."""
        with np.errstate(over="ignore"):
            one = mix(keys[:, 0] + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
            two = mix(keys[:, 1] ^ np.uint64(level)) | np.uint64(1)
            steps = np.arange(hashes, dtype=np.uint64)
            return (one[:, None] + steps * two[:, None]) % np.uint64(n_words * 64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.positions(self.level, self.hashes, len(self.bits), keys)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade(NamedTuple):
    levels: list[Bloom]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """A key belongs to the list if the first level that does not pass it is an even one."""
        result = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for n, level in enumerate(self.levels):
            passed = level.has(keys[open_]) if len(open_) else np.zeros(0, bool)
            result[open_[~passed]] = n % 2 == 1
            open_ = open_[passed]
        result[open_] = len(self.levels) % 2 == 1
        return result


def _pairs(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def key_universe(pages: DataFrame, url: str, rules: list[Rule]) -> DataFrame:
    """The digests of all keys that the pages have, each once."""
    shape = Shape(rules)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {k for host, path in zip(*(c.to_pylist() for c in batch.columns)) for k in shape.keys(host, path)}
            yield pa.RecordBatch.from_pydict({"key": pa.array([digest(k) for k in seen], pa.binary())})

    parts = pages.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    return parts.mapInArrow(keys, "key binary").distinct()


def first_rate(listed: int, others: int) -> float:
    """The share of other keys that level 1 may pass wrongly, so that level 2 is smaller than it."""
    return min(0.5, listed / (math.sqrt(2) * others)) if others else 0.5


def build_cascade(listed: DataFrame, universe: DataFrame, false_positives: float | None = None) -> Cascade:
    """A cascade for the keys of listed among those of universe (both: one binary column ``key`` of 16 bytes).

    The bits of a level are gathered as 64-bit words, OR-ed on the executors, so no keys reach the driver; its size follows the number of listed keys, unless
    false_positives sets the share that each level may pass wrongly.
    """
    spark = universe.sparkSession
    tagged = listed.select("key", F.lit(1).alias("listed")).unionByName(universe.select("key", F.lit(0).alias("listed")))
    tagged = write_shared(tagged.groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    inside, outside = tagged.where("listed = 1").select("key"), tagged.where("listed = 0").select("key")
    levels: list[Bloom] = []
    written = [tagged]
    n, others = inside.count(), outside.count()
    while n:
        n_words, hashes = Bloom.shape(n, false_positives or (0.5 if levels else first_rate(n, others)))
        level = len(levels)

        def set_bits(batches: Iterator[pa.RecordBatch], level=level, hashes=hashes, n_words=n_words) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = Bloom.positions(level, hashes, n_words, _pairs(batch.column(0).to_pylist())).ravel()
                yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        bits = np.zeros(n_words, np.uint64)
        rows = inside.mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        bloom = Bloom(level, hashes, bits)
        levels.append(bloom)
        sent = spark.sparkContext.broadcast(bloom)

        def passed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(sent.value.has(_pairs(batch.column(0).to_pylist()))))

        wrong = write_shared(outside.mapInArrow(passed, "key binary"), "url-false-positives")
        written.append(wrong)
        inside, outside = wrong, inside
        n = inside.count()
    for df in written:
        drop_shared(df)
    return Cascade(levels)


def judged_by_join(pages: DataFrame, page_id: str, url: str, rules: list[Rule], default: str) -> DataFrame:
    """The same as judge() for a very long list: the pages' keys meet the listed keys in a join."""
    shape = Shape(rules)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_pages = [shape.keys(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            flat = [(i, n, digest(k)) for i, ks in enumerate(of_pages) for n, k in enumerate(ks)]
            rows = pa.array([f[0] for f in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns] + [pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.binary())], names=["host", "path", "turn", "key"])

    spark = pages.sparkSession
    parts = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    listed = spark.createDataFrame([(digest((r.host, r.path)), r.text, r.verdict) for r in rules], "key binary, rule string, verdict string")
    found = parts.select("host", "path").distinct().mapInArrow(keys, "host string, path string, turn int, key binary").join(listed, "key")
    best = found.groupBy("host", "path").agg(F.min(F.struct("turn", "rule", "verdict")).alias("best"))
    joined = parts.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, page_id: str, url: str, rules: list[Rule], default: str = "allow", most_mb: int = 64, false_positives: float | None = None) -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict of every page."""
    spark = pages.sparkSession
    rules = list(dict.fromkeys(rules))
    if len(rules) * 12 > most_mb << 20:  # 12 bytes a listed key: 1.44 x 64 bits
        return judged_by_join(pages, page_id, url, rules, default)
    universe = write_shared(key_universe(pages, url, rules), "url-universe")
    verdicts = sorted({r.verdict for r in rules})
    cascades = {}
    for verdict in verdicts:
        own = [(digest((r.host, r.path)),) for r in rules if r.verdict == verdict]
        others = [(digest((r.host, r.path)),) for r in rules if r.verdict != verdict]
        listed = spark.createDataFrame(own, "key binary")
        cascades[verdict] = build_cascade(listed, universe.unionByName(spark.createDataFrame(others, "key binary")), false_positives)
    drop_shared(universe)
    shape, sent = Shape(rules), spark.sparkContext.broadcast(cascades)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = [shape.keys(h, p) for h, p in zip(hosts, paths)]
            flat = _pairs(digest(k) for of_page in keys for k in of_page)
            found = {v: c.has(flat) for v, c in sent.value.items()}
            rule, verdict, i = [], [], 0
            for of_page in keys:
                hit = next(((k, v) for n, k in enumerate(of_page) for v in found if found[v][i + n]), None)
                rule.append(hit and hit[0][0] + hit[0][1])
                verdict.append(hit[1] if hit else default)
                i += len(of_page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    parts = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string")
