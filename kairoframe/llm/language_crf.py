"""Language ID of code-switched text by a linear-chain conditional random field.

Every word gets a label, a language. A word's features are the word itself (the lexicon), its prefixes and suffixes of one to three
bytes and its byte 2- and 3-grams, hashed into one weight table with a column per language; transitions between the languages of
neighbouring words are learnt too. Forward-backward gives each word's marginals; a document's language is that with the
largest share of its words' marginals, and the share is its score.

The field is fitted on at most ``most`` labelled documents of ``most_mb`` together (parameters), chosen by their ids' hashes: their whole texts, in sequences of
``LENGTH`` words; half the sequences splice two documents', so that switches of language are learnt. Prediction reads whole texts. A text is one
chain, worked on in blocks of ``LENGTH`` words side by side: a block is first reduced to the matrix that carries a forward message through it, then messages pass
from block to block, and each block fills in its own words. So memory is bounded, and long documents cost no more a word than short ones.

Words are runs of ASCII letters and bytes above 127, A-Z lower-cased. The language is ``und`` with score 0 if text is null or has no
letter, or if nothing could be learnt. Rows given twice are predicted alike. Equal shares go to the language that sorts first.
Documents with a null id are never held out. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.bytetext import LOWER, RangeHash, mix, slices, text_bytes
from kairoframe.llm.sampling import bounded_sample
from kairoframe.llm.storage import bounded_batches

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
BITS = 18
LENGTH = 64
SLICE = 1 << 20
UNKNOWN = "und"
KINDS = {name: np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i, name in enumerate(["word", "p1", "p2", "p3", "s1", "s2", "s3", "g2", "g3"])}


def letter_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    solid = LETTER[raw]
    border = np.zeros(len(raw), bool)
    border[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts, stops = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | border[1:]
    stops[:-1] &= ~solid[1:] | border[1:]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(offsets, start, side="right") - 1


def features(hashed: RangeHash, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its features' places in the weight table, one after another, and the word of each."""
    n = len(start)
    own = np.arange(n)
    size = end - start
    values, owners = [hashed(start, end) ^ KINDS["word"]], [own]
    for k in (1, 2, 3):
        longer = np.flatnonzero(size >= k)
        values += [hashed(start[longer], start[longer] + k) ^ KINDS[f"p{k}"], hashed(end[longer] - k, end[longer]) ^ KINDS[f"s{k}"]]
        owners += [longer, longer]
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        owner = np.repeat(own, count)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        values.append(hashed(at, at + k) ^ KINDS[f"g{k}"])
        owners.append(owner)
    return (mix(np.concatenate(values)) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


class Crf(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # places x languages
    transitions: np.ndarray  # from, to
    first: np.ndarray

    def emissions(self, hashed: RangeHash, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        place, owner = features(hashed, start, end)
        return np.stack([np.bincount(owner, self.weights[place, j], minlength=len(start)) for j in range(len(self.languages))], axis=1)

    def messages(self, scores: np.ndarray, mask: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """scores: chains x length x languages; mask: the words that there are, from the left; before: what a chain's first word is met with (by default
        that a text begins), after: the backward message at its last word. Forward and backward messages, scaled at each step, local factors
        and transition factors."""
        length = scores.shape[1]
        local, step = self.factors(scores, mask)
        forward, backward = np.empty_like(local), np.ones_like(local)
        if after is not None:
            backward[:] = after[:, None]
        forward[:, 0] = (self.start() if before is None else before) * local[:, 0]
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = (forward[:, t - 1] @ step) * local[:, t]
            forward[:, t] = np.where(mask[:, t, None], a / a.sum(axis=1, keepdims=True), forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            b = (backward[:, t + 1] * local[:, t + 1]) @ step.T
            backward[:, t] = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), backward[:, t])
        return forward, backward, local, step

    def factors(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        local[~mask] = 1.0
        return local, np.exp(self.transitions - self.transitions.max()).astype(local.dtype)

    def start(self) -> np.ndarray:
        return np.exp(self.first - self.first.max())

    def carried(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of each chain the matrix, up to a factor, that takes what its first word is met with to the forward message at its last word."""
        local, step = self.factors(scores, mask)
        k = local.shape[2]
        out = np.eye(k, dtype=local.dtype)[None] * local[:, 0, None, :]
        for t in range(1, local.shape[1]):
            more = (out @ step) * local[:, t, None, :]
            more /= more.sum(axis=(1, 2), keepdims=True)
            out = np.where(mask[:, t, None, None], more, out)
        return out

    def marginals(self, scores: np.ndarray, mask: np.ndarray, number: np.ndarray) -> np.ndarray:
        """number: of each chain, which block of its text it is; a text's blocks follow each other."""
        before = np.tile(self.start(), (len(scores), 1))
        after = np.ones_like(before)
        joined = np.flatnonzero(number > 0)
        if len(joined):
            parts = np.unique(np.concatenate([joined - 1, joined]))
            through = np.zeros((len(scores), *[scores.shape[2]] * 2))
            for some in np.array_split(parts, -(-len(parts) // 4096)):
                through[some] = self.carried(scores[some], mask[some])
            step = np.exp(self.transitions - self.transitions.max())
            joined = joined[np.argsort(number[joined], kind="stable")]
            turns = np.split(joined, np.flatnonzero(np.diff(number[joined])) + 1)
            for here in turns:  # from block to block, over all texts at once
                a = np.einsum("ni,nij->nj", before[here - 1], through[here - 1]) @ step
                before[here] = a / a.sum(axis=1, keepdims=True)
            for here in reversed(turns):
                b = np.einsum("nij,nj->ni", through[here], after[here]) @ step.T
                after[here - 1] = b / b.sum(axis=1, keepdims=True)
        kind = scores.dtype
        forward, backward, _, _ = self.messages(scores, mask, before.astype(kind), after.astype(kind))
        both = forward * backward
        return both / both.sum(axis=2, keepdims=True)


def _training_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: their features' places, word after word, how many each has, and its text; some texts at a time, since the driver holds them."""
    places, counts, owners = [], [], []
    for a in range(0, len(texts), 256):
        raw, offsets = text_bytes(pa.array(texts[a : a + 256], pa.large_string()))
        start, end, text = letter_words(raw, offsets)
        place, owner = features(RangeHash(LOWER[raw]), start, end)
        places.append(place[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(start)).astype(np.int32))
        owners.append((text + a).astype(np.int32))
    return np.concatenate(places), np.concatenate(counts), np.concatenate(owners)


def fit(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 6, batch: int = 128, rate: float = 0.3) -> Crf | None:
    """texts: windows of words; labels: their languages. Stochastic gradients (Adagrad) of the log-likelihood."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    place, spans, text = _training_features(texts)
    cuts = np.concatenate([[0], np.cumsum(spans)])
    label = np.array([languages.index(x) for x in labels])[text]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    k = len(languages)
    crf = Crf(languages, np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k))
    squares = [np.full(x.shape, 1e-6) for x in (crf.weights, crf.transitions, crf.first)]
    for _ in range(epochs):
        windows = rng.permutation(len(texts))
        half = len(windows) // 2
        chains = [np.arange(bounds[i], bounds[i + 1]) for i in windows[:half]]
        rest = windows[half:]
        for a, b in zip(rest[::2], rest[1::2]):  # spliced: part of one window, then part of another
            x, y = np.arange(bounds[a], bounds[a + 1]), np.arange(bounds[b], bounds[b + 1])
            chains.append(np.concatenate([x[: rng.integers(len(x) // 2, len(x) + 1)], y[rng.integers(0, len(y) // 2 + 1) :]])[:LENGTH])
        chains = [c for c in chains if len(c)]
        for i in range(0, len(chains), batch):
            some = chains[i : i + batch]
            length = max(map(len, some))
            grid = np.zeros((len(some), length), np.int64)
            mask = np.zeros((len(some), length), bool)
            for j, c in enumerate(some):
                grid[j, : len(c)], mask[j, : len(c)] = c, True
            flat = grid[mask]
            spans = cuts[flat + 1] - cuts[flat]
            own = np.repeat(np.arange(len(flat)), spans)
            at = place[np.repeat(cuts[flat], spans) + np.arange(len(own)) - np.repeat(np.cumsum(spans) - spans, spans)]
            emitted = np.stack([np.bincount(own, crf.weights[at, j], minlength=len(flat)) for j in range(k)], axis=1)
            scores = np.zeros((*mask.shape, k))
            scores[mask] = emitted
            forward, backward, local, step = crf.messages(scores, mask)
            gamma = forward * backward
            gamma /= gamma.sum(axis=2, keepdims=True)
            # Neighbours' joint marginals from the same messages.
            joint = forward[:, :-1, :, None] * step * (local * backward)[:, 1:, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            both = mask[:, 1:] & mask[:, :-1]
            pairs = joint[both].sum(axis=0)
            truth = np.zeros((len(flat), k))
            truth[np.arange(len(flat)), label[flat]] = 1
            seen = np.zeros((k, k))
            np.add.at(seen, (label[grid[:, :-1][both]], label[grid[:, 1:][both]]), 1)
            n = len(some)
            error = gamma[mask] - truth
            gradient = np.stack([np.bincount(at, error[own, j], minlength=1 << BITS) for j in range(k)], axis=1) / n
            start_truth = np.bincount(label[grid[:, 0]], minlength=k)
            for value, g, square in zip((crf.weights, crf.transitions, crf.first), (gradient, (pairs - seen) / n, (gamma[:, 0].sum(axis=0) - start_truth) / n), squares):
                square += g * g
                value -= rate * g / np.sqrt(square)
    return Crf(languages, crf.weights.astype(np.float32), crf.transitions, crf.first)


def train(labelled: DataFrame, most: int = 1000, most_mb: int = 16) -> Crf | None:
    """labelled: doc_id, text, lang. Of at most ``most`` documents, in the order of their ids' hashes, those that fit into ``most_mb`` together come to the driver, whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            raw, offsets = text_bytes(batch.column(0))
            start, end, text = letter_words(raw, offsets)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            out = []
            for i, lang in enumerate(batch.column(1).to_pylist()):
                for a in range(int(bounds[i]), int(bounds[i + 1]), LENGTH):
                    b = min(a + LENGTH, int(bounds[i + 1]))
                    out.append((lang, bytes(raw[start[a] : end[b - 1]]).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], names=["lang", "window"])

    sample = bounded_sample(labelled.where(F.col("lang").isNotNull()), "doc_id", most, most_mb << 20)
    rows = sample.orderBy("doc_id", "lang", "text").select("text", "lang").mapInArrow(cut, "lang string, window string").toArrow()
    return fit(rows["window"].to_pylist(), rows["lang"].to_pylist())


def predict(documents: DataFrame, crf: Crf | None) -> DataFrame:
    """documents (columns doc_id, text, then any), all columns, with lang_pred, score and n_switches (changes of the likeliest language
    between neighbouring words)."""
    bounded_batches(documents.sparkSession)
    names = documents.columns
    sent = documents.sparkSession.sparkContext.broadcast(crf)
    lettered = documents.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            n_texts = batch.num_rows
            letter = batch.column("__letter").to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(batch.column("text"))
            start, end, text = letter_words(raw, offsets)
            if crf is None or not len(start):
                best, share, switches = np.zeros(n_texts, int), np.zeros(n_texts), np.zeros(n_texts, int)
                known = np.zeros(n_texts, bool)
            else:
                gamma, switches = _marginals_of_words(crf, LOWER[raw], start, end, text, n_texts)
                mass = np.stack([np.bincount(text, gamma[:, j], minlength=n_texts) for j in range(len(crf.languages))], axis=1)
                total = mass.sum(axis=1)
                best, known = mass.argmax(axis=1), letter & (total > 0)
                share = np.where(known, mass.max(axis=1) / np.maximum(total, 1e-12), 0.0)
            lang = [crf.languages[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(np.clip(share, 0, 1)), pa.array(np.where(known, switches, 0), pa.int32())],
                names=[*names, "lang_pred", "score", "n_switches"],
            )

    return lettered.mapInArrow(label, f"{schema}, lang_pred string, score double, n_switches int")


def known(documents: DataFrame, crf: Crf | None, least: float = 0.5) -> DataFrame:
    """documents, all columns, of those with a known language whose share is at least ``least``."""
    others = [c for c in documents.columns if c != "text"]
    renamed = documents.select("text", *(F.col(c).alias(f"__{i}") for i, c in enumerate(others)))  # names may clash with those of predict()
    judged = predict(renamed, crf).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return judged.select("text", *(F.col(f"__{i}").alias(c) for i, c in enumerate(others))).select(*documents.columns)


def _marginals_of_words(crf: Crf, lowered: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and the number of switches in every text. Each distinct word's features are looked up once."""
    hashed = RangeHash(lowered)
    _, one, at = np.unique(hashed(start, end), return_index=True, return_inverse=True)
    emitted = crf.emissions(hashed, start[one], end[one]).astype(np.float32)
    count = np.bincount(text, minlength=n_texts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)  # of the word in its text
    chains = -(-count // LENGTH)
    chain = np.repeat(np.cumsum(chains) - chains, count) + place // LENGTH
    scores = np.zeros((int(chains.sum()), LENGTH, len(crf.languages)), np.float32)
    mask = np.zeros(scores.shape[:2], bool)
    scores[chain, place % LENGTH] = emitted[at]
    mask[chain, place % LENGTH] = True
    number = np.arange(len(scores)) - np.repeat(np.cumsum(chains) - chains, chains)
    gamma = crf.marginals(scores, mask, number)[chain, place % LENGTH]
    likeliest = gamma.argmax(axis=1)
    change = np.flatnonzero((likeliest[1:] != likeliest[:-1]) & (text[1:] == text[:-1]))
    return gamma, np.bincount(text[change], minlength=n_texts)
