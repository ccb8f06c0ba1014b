"""Toxicity by multiple-instance learning.

Only documents carry labels. A document is a bag of sentences; a sentence's score is the logistic function of the weights of its words, and a
document is toxic unless all its sentences are clean: P = 1 - prod(1 - p_s), the noisy-or. Maximising the documents' likelihood
distributes the blame among the sentences, so that the model also says where the offence is.

A sentence's features are its words and their first 4, 5 and 6 bytes, so that inflected forms share weights. The model is fitted on at
most ``most`` labelled documents of ``most_mb`` together (parameters). The executors count in how many documents of either label each feature is; only features
whose counts differ by label (chi-squared of ``least_chi`` or more) come to the driver, where proximal Adam with an L1 penalty fits the
likelihood. What is sent to the executors is a short sorted list of hashes. Scoring reads whole texts, in slices of Arrow batches,
without a shuffle.

Words are runs of letters, digits and bytes above 127, A-Z lower-cased; a sentence ends at . ! ? or a line break.
A null or empty text is one empty sentence; a text may be of any length below 2 GB. Of sentences with the same score the first is the worst. Of several
texts of one labelled id the first in order is learnt from. A document with several labels is toxic if one says so; null labels are not learnt from.
Without labelled rows of both kinds every sentence scores alike. Rows given twice are scored twice. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import LOWER, RangeHash, mix, slices, text_bytes
from kairoframe.llm.sampling import within_bytes
from kairoframe.llm.storage import bounded_batches, write_shared

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[[33, 46, 63, 10]] = True
SLICE = 2 << 20
SLOTS = 22
PREFIXES = (4, 5, 6)


class Bags(NamedTuple):
    """Features of many documents: a hash and a sentence for each, in no order; a document for each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    begin: np.ndarray  # of each sentence, in its document's bytes
    end: np.ndarray


def bags(raw: np.ndarray, offsets: np.ndarray) -> Bags:
    breaks = np.flatnonzero(STOP[raw]) + 1  # a sentence ends after its stop
    inner = breaks[~np.isin(breaks, offsets)]
    empty = np.flatnonzero(np.diff(offsets) == 0)
    full = np.flatnonzero(np.diff(offsets))
    # Every text has a sentence that begins with it, an empty one too.
    begin = np.concatenate([offsets[full], inner, offsets[empty]])
    document = np.concatenate([full, np.searchsorted(offsets, inner, side="right") - 1, empty])
    order = np.lexsort((begin, document))
    begin, document = begin[order], document[order]
    end = np.append(begin[1:], offsets[-1])
    solid = WORD[raw]
    starts = solid.copy()
    stops = solid.copy()
    if len(raw):
        border = np.zeros(len(raw), bool)
        border[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts[1:] &= ~solid[:-1] | border[1:]
        stops[:-1] &= ~solid[1:] | border[1:]
    at, to = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    sentence = np.searchsorted(begin, at, side="right") - 1
    hashed = RangeHash(LOWER[raw])
    values, owners = [hashed(at, to)], [sentence]
    for k in PREFIXES:
        longer = np.flatnonzero(to - at > k)
        values.append(hashed(at[longer], at[longer] + k) ^ mix(np.array([k], np.uint64)))
        owners.append(sentence[longer])
    return Bags(np.concatenate(values), np.concatenate(owners), document, begin - offsets[document], end - offsets[document])


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        """Which hashes may be known, by their upper bits: most words are ruled out by one look."""
        table = np.zeros(1 << SLOTS, bool)
        table[self.words >> np.uint64(64 - SLOTS)] = True
        return table

    def sentence_scores(self, b: Bags, slots: np.ndarray) -> np.ndarray:
        z = np.full(len(b.document), self.bias)
        maybe = np.flatnonzero(slots[b.feature >> np.uint64(64 - SLOTS)]) if len(self.words) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, b.feature[maybe]), max(len(self.words) - 1, 0))
        known = self.words[at] == b.feature[maybe] if len(maybe) else np.zeros(0, bool)
        z += np.bincount(b.sentence[maybe[known]], self.weights[at[known]], minlength=len(z))
        return z


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


def fit(features: np.ndarray, at: np.ndarray, sentence: np.ndarray, document: np.ndarray, toxic: np.ndarray, steps: int = 150, rate: float = 0.15, penalty: float = 1e-4) -> Model:
    """features: sorted hashes; at, sentence: of each occurrence, its feature's place and its sentence; document: of each sentence; toxic:
    of each document."""
    n, y = len(toxic), toxic.astype(float)
    theta, bias = np.zeros(len(features)), -5.0
    m, v, mb, vb = np.zeros(len(features)), np.zeros(len(features)), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, theta[at], minlength=len(document))
        clean = -np.bincount(document, softplus(z), minlength=n)  # log of prod(1 - p)
        odds = np.where(y > 0, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 0.0)
        slope = logistic(z) * np.where(y > 0, -odds, 1.0)[document] / n
        g = np.bincount(at, slope[sentence], minlength=len(features))
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        own = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta -= own * m / (1 - 0.9**step)
        theta = np.sign(theta) * np.maximum(np.abs(theta) - own * penalty, 0)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    left = np.flatnonzero(np.abs(theta) > 1e-3)
    return Model(features[left], theta[left], float(bias))


def train(documents: DataFrame, labels: DataFrame, most: int = 12_000, most_mb: int = 64, least_documents: int = 4, least_chi: float = 6.0) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic (0 or 1), of which at most ``most`` are used, and of these, in the same order,
    those whose texts fit into ``most_mb`` together. They are chosen by their ids' hashes and sent to the documents, so that no text is shuffled for the choice."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
    # Of several texts of one id the first in order.
    found = documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = write_shared(within_bytes(found, "doc_id", most_mb << 20), "labelled")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            b = bags(*text_bytes(batch.column(0)))
            owner = b.document[b.sentence]
            order = np.lexsort((owner, b.feature))
            feature, owner = b.feature[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(feature[new].view(np.int64)), batch.column(1).take(pa.array(owner[new]))], names=["feature", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(distinct, "feature long, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    expected = F.col("n") * (n_toxic / n)
    chi = (F.col("k") - expected) ** 2 / (expected * (1 - n_toxic / n))
    kept = counts.where((F.col("n") >= least_documents) & (chi >= least_chi)).select("feature").toArrow()["feature"].to_numpy()
    features = np.sort(kept.view(np.uint64))
    sent = sample.sparkSession.sparkContext.broadcast(features)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = sent.value
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            b = bags(*text_bytes(batch.column(0)))
            place = np.minimum(np.searchsorted(features, b.feature), max(len(features) - 1, 0))
            known = np.flatnonzero(features[place] == b.feature) if len(features) else np.zeros(0, np.int64)
            known = known[np.argsort(b.sentence[known], kind="stable")]
            first = np.searchsorted(b.document, np.arange(batch.num_rows + 1))
            cuts = np.searchsorted(b.sentence[known], first)
            rows = [(place[known[i:j]].astype(np.int32).tobytes(), (b.sentence[known[i:j]] - s).astype(np.int32).tobytes(), int(t - s)) for i, j, s, t in zip(cuts[:-1], cuts[1:], first[:-1], first[1:])]
            at, sentence, size = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(sentence, pa.binary()), pa.array(size, pa.int32())], names=["toxic", "at", "sentences", "n"])

    got = sample.orderBy("doc_id").select("text", "toxic").mapInArrow(occurrences, "toxic int, at binary, sentences binary, n int").toArrow()
    at, sentence = ([np.frombuffer(x, np.int32) for x in got[c].to_pylist()] for c in ("at", "sentences"))
    size = got["n"].to_numpy()
    first = np.cumsum(size) - size
    return fit(features, np.concatenate(at), np.concatenate([s + f for s, f in zip(sentence, first)]), np.repeat(np.arange(len(size)), size), got["toxic"].to_numpy())


SCORES = "score double, n_sentences int, worst_sentence int, worst_score double, offending array<struct<begin: int, end: int, score: double>>"


def score(documents: DataFrame, model: Model, offending_from: float = 0.5) -> DataFrame:
    """documents (columns doc_id, text, then any) without text, with the document's score, its worst sentence and the byte ranges of the offending ones."""
    bounded_batches(documents.sparkSession)
    names = [c for c in documents.columns if c != "text"]
    sent = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        slots = model.slots()
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            b = bags(*text_bytes(batch.column("text")))
            z = model.sentence_scores(b, slots)
            p = logistic(z)
            n = np.bincount(b.document, minlength=batch.num_rows)
            whole = -np.expm1(-np.bincount(b.document, softplus(z), minlength=batch.num_rows))
            first = np.concatenate([[0], np.cumsum(n)])
            order = np.lexsort((np.arange(len(z)), -z, b.document))
            worst = order[first[:-1]]
            hits = np.flatnonzero(p >= offending_from)
            cuts = np.searchsorted(b.document[hits], np.arange(batch.num_rows + 1))
            found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(b.begin[hits], pa.int32()), pa.array(b.end[hits], pa.int32()), pa.array(p[hits])], names=["begin", "end", "score"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.clip(whole, 0, 1)), pa.array(n, pa.int32()), pa.array(worst - first[:-1], pa.int32()), pa.array(p[worst]), found.cast(spans)],
                names=[*names, "score", "n_sentences", "worst_sentence", "worst_score", "offending"],
            )

    return documents.mapInArrow(scored, f"{schema}, {SCORES}")
