import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kairoframe.llm import toxicity
from kairoframe.llm.bytetext import text_bytes


def sentences(text):
    """Byte ranges of the sentences, by hand."""
    raw, out, begin = (text or "").encode(), [], 0
    for i, c in enumerate(raw):
        if c in b".!?\n" and i + 1 < len(raw):
            out.append((begin, i + 1))
            begin = i + 1
    return [*out, (begin, len(raw))]


def test_sentences_of_batches():
    texts = ["One. Two!Three", None, "", "a\n\nb", "...", "x", "é.é", "tail."]
    b = toxicity.bags(*text_bytes(pa.array(texts, pa.string())))
    got = [[(int(x), int(y)) for x, y, d in zip(b.begin, b.end, b.document) if d == i] for i in range(len(texts))]
    assert got == [sentences(t) for t in texts]


def test_scores_likelihood_and_gradient_against_plain_loops():
    r = np.random.default_rng(2)
    features = np.sort(r.integers(0, 2**62, 5).astype(np.uint64))
    document = np.array([0, 0, 1, 2, 2, 2])
    at, sentence = np.array([0, 1, 1, 2, 3, 4, 0]), np.array([0, 0, 1, 2, 3, 4, 5])
    toxic = np.array([1, 0, 1])
    model = toxicity.fit(features, at, sentence, document, toxic, steps=400, penalty=0.0)
    weights = dict(zip(model.words.tolist(), model.weights))

    def loss(theta, bias):
        total = 0.0
        for d in range(3):
            clean = 1.0
            for s in np.flatnonzero(document == d):
                z = bias + sum(theta[a] for a, x in zip(at, sentence) if x == s)
                clean *= 1 - 1 / (1 + np.exp(-z))
            total -= np.log(1 - clean) if toxic[d] else np.log(clean)
        return total / 3

    theta = np.array([weights.get(int(f), 0.0) for f in features])
    assert loss(theta, model.bias) < min(0.1, loss(np.zeros(5), -5.0))
    # One step from the start goes down the gradient of that likelihood, by central differences.
    small = toxicity.fit(features, at, sentence, document, toxic, steps=1, rate=1e-2, penalty=0.0)
    moved = {int(f): w for f, w in zip(small.words, small.weights)}
    for i, f in enumerate(features):
        up, down = np.zeros(5), np.zeros(5)
        up[i], down[i] = 1e-4, -1e-4
        slope = (loss(up, -5.0) - loss(down, -5.0)) / 2e-4
        assert np.sign(moved.get(int(f), 0.0)) == -np.sign(round(slope, 6))
    texts = ["Bad word. Fine words here!", "fine", ""]
    b = toxicity.bags(*text_bytes(pa.array(texts)))
    known = np.unique(b.feature)[:6]
    scored = toxicity.Model(known, r.normal(size=6), -1.0)
    z = scored.sentence_scores(b, scored.slots())
    for s in range(len(b.document)):
        plain = -1.0 + sum(w for f, o in zip(b.feature, b.sentence) if o == s for k, w in zip(known, scored.weights) if k == f)
        assert abs(z[s] - plain) < 1e-9


def corpus(prose, n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = r.random() < 0.3
        parts = [prose(seed * 10_000 + i * 10 + k, r.randint(4, 9)) + "." for k in range(r.randint(2, 12))]
        if toxic:
            for k in r.sample(range(len(parts)), min(2, len(parts))):
                parts[k] = f"You {r.choice(['vile', 'grotty', 'nasty'])}{r.choice(['', 'ness', 'ish'])} thing."
        rows.append((i, " ".join(parts), int(toxic)))
    return rows


def test_held_out_documents_and_their_sentences(spark, prose):
    rows = corpus(prose, 600, 1)
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where("doc_id % 3 != 0"))
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [(i, t, y) for i, t, y in rows if i % 3 == 0]
    assert np.mean([(got[i].score >= 0.5) == y for i, _, y in held]) > 0.97
    for i, text, y in held:
        if y and got[i].score >= 0.5:
            for o in got[i].offending:
                assert "You " in text.encode()[o.begin : o.end].decode()


def test_nulls_empty_long_and_repeated(spark, prose):
    docs = [(1, None), (2, ""), (None, "x."), (3, "a."), (3, "a."), (4, prose(1, 40_000))]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (3, 1), (None, 1), (9, 0), (4, 0)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert [r.n_sentences for r in got if r.doc_id in (1, 2)] == [1, 1]


def test_nothing_to_learn_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert toxicity.score(df, model).first().score < 0.5
    assert toxicity.score(df.where(F.lit(False)), toxicity.train(df.limit(0), labels.limit(0))).collect() == []
