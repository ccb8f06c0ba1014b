import itertools
import random

import numpy as np

from kairoframe.llm import language_crf as L

SYLLABLES = {"aa": ["sch", "ung", "keit"], "bb": ["eau", "oux", "ment"], "cc": ["ción", "ñar", "ado"]}


def text(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    crf = L.Crf(["a", "b", "c"], np.zeros((1, 3)), r.normal(size=(3, 3)), r.normal(size=3))
    scores, mask = r.normal(size=(2, 5, 3)), np.ones((2, 5), bool)
    mask[1, 3:] = False
    got = crf.marginals(scores, mask, np.zeros(2, int))
    for chain, n in ((0, 5), (1, 3)):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(crf.first[path[0]] + sum(scores[chain, t, s] for t, s in enumerate(path)) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                want[t, s] += w
        assert np.allclose(got[chain, :n], want / want.sum(axis=1, keepdims=True))


def test_messages_pass_between_the_blocks_of_a_text():
    r = np.random.default_rng(1)
    crf = L.Crf(["a", "b", "c"], np.zeros((1, 3)), 2 * r.normal(size=(3, 3)), r.normal(size=3))
    lengths, block = [23, 4, 5, 11], 5
    wholes = [r.normal(size=(n, 3)) for n in lengths]
    number = np.concatenate([np.arange(-(-n // block)) for n in lengths])
    scores, mask, i = np.zeros((len(number), block, 3)), np.zeros((len(number), block), bool), 0
    for n, whole in zip(lengths, wholes):
        for a in range(0, n, block):
            part = whole[a : a + block]
            scores[i, : len(part)], mask[i, : len(part)] = part, True
            i += 1
    got = crf.marginals(scores, mask, number)[mask]
    want = [crf.marginals(w[None], np.ones((1, len(w)), bool), np.zeros(1, int))[0] for w in wholes]
    assert np.allclose(got, np.concatenate(want))


def test_the_sample_is_bounded_in_documents_and_bytes(spark):
    from kairoframe.llm.sampling import bounded_sample

    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(None, "y")], "doc_id long, text string")
    assert bounded_sample(df, "doc_id", 20, 10_000).count() == 20
    assert bounded_sample(df, "doc_id", 20, 750).count() == 7


def model_and_rows(spark, n=240):
    r = random.Random(4)
    rows = [(i, text(lang, r.randint(1, 200), r), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), n))]
    df = spark.createDataFrame([(*x, 9.0, "z") for x in rows], "doc_id long, text string, lang string, n double, language string")
    return L.train(df.where("doc_id % 4 != 0").select("doc_id", "text", "lang")), rows, df


def test_held_out_accuracy_and_switches(spark):
    crf, rows, df = model_and_rows(spark)
    got = {r.doc_id: r for r in L.predict(df.select("doc_id", "text"), crf).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 0]) > 0.95
    r = random.Random(8)
    mixed = spark.createDataFrame([(1, text("aa", 30, r) + " " + text("bb", 12, r))], "doc_id long, text string")
    one = L.predict(mixed, crf).first()
    assert one.lang_pred == "aa" and one.n_switches == 1 and 0.6 < one.score < 0.8


def test_nulls_no_letters_long_and_repeated(spark):
    crf, _, _ = model_and_rows(spark, 60)
    r = random.Random(1)
    rows = [(1, None), (2, ""), (3, "12 !! 34"), (4, "😀"), (5, text("bb", 30_000, r)), (5, "ung"), (5, "ung"), (None, "eau oux")]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string"), crf).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id in (1, 2, 3, 4):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            assert x.lang_pred in SYLLABLES and 0 < x.score <= 1


def test_nothing_learnt_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert L.train(df) is None
    assert L.predict(df.select("doc_id", "text"), None).first().lang_pred == "und"
    assert L.predict(df.limit(0).select("doc_id", "text"), None).collect() == []


def test_filter_keeps_clashing_columns(spark):
    crf, _, _ = model_and_rows(spark, 60)
    df = spark.createDataFrame([(1, "ung keit", "x", 0.1), (2, "12", "y", 0.2)], "doc_id long, text string, lang_pred string, score double")
    assert [tuple(x) for x in L.known(df, crf).collect()] == [(1, "ung keit", "x", 0.1)]
