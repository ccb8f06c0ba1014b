import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.llm import suffix_index


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(documents, rows, length=40, choice=20, batches=3):
    df = documents(rows)
    repeats = suffix_index.repeats(df, length=length, choice=choice, batches=batches)
    return sorted((tuple(r)[:5] for r in suffix_index.removals(df.select("doc_id", "text"), repeats, length).collect()), key=repr)


@pytest.mark.parametrize("hot", [16 << 20, 60])
@pytest.mark.parametrize("batches", [1, 4, 5])
def test_against_brute_force(documents, prose, hot, batches, monkeypatch):
    monkeypatch.setattr(suffix_index, "HOT_BYTES", hot)
    r = random.Random(batches)
    passages = [prose(i, 12) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(100 + i, r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            parts += [p[a : a + r.randint(30, 80)], prose(500 + 10 * i + len(parts), r.randint(0, 4))]
        rows.append((i, " é".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1][5:-5])]
    assert found(documents, rows, batches=batches) == brute(rows, 40)


def test_periodic_short_null_and_repeated(documents, prose):
    rows = [(1, "a" * 300), (2, "ab" * 30), (3, "ba" * 30), (4, None), (5, ""), (6, "short"), (7, prose(1, 15)), (7, prose(1, 15)), (None, prose(2, 15)), (None, prose(2, 15)), (8, "x" * 40), (9, "日本語" * 20)]
    assert found(documents, rows) == brute(rows, 40)


def test_one_long_text_repeats_itself(documents, prose):
    text = prose(3, 4000)
    rows = [(1, text + " gap " + text[100:20_000]), (2, prose(4, 10))]
    assert found(documents, rows, batches=2) == brute(rows, 40)


def test_empty_table(documents):
    assert found(documents, []) == []


def test_levels_merge_geometrically(spark, documents):
    family = suffix_index.Family(spark)
    docs = documents([(1, "abc" * 100)]).selectExpr("doc_id", "0 AS version", "text")
    sizes = []
    for _ in range(6):
        family.insert(suffix_index.entries(docs, 40, 20))
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]


def test_many_texts_without_an_id_are_documents_of_their_own(spark, documents, prose):
    rows = [(None, prose(i, 15 + i % 7) + (prose(9000 + i % 40, 12) if i % 3 else "")) for i in range(700)]
    assert found(documents, rows, batches=2) == brute(rows, 40)
    keys = documents(rows).select(suffix_index.document_key(F.col("doc_id"), F.col("text")), suffix_index.version(F.col("text")))
    assert keys.distinct().count() == len({t for _, t in rows})


def test_string_hashes_keep_all_their_bits():
    hashes = [np.array([1, 1 + (5 << 50), 7], "<u8").tobytes(), np.array([1 << 63 | 1, 1], "<u8").tobytes()]
    row, number, value = suffix_index._spread(np.array([3, 3], np.int64), hashes)
    assert row.tolist() == [0, 0, 0, 1, 1] and number.tolist() == [0, 1, 2, 0, 1]
    assert len(set(value.tolist())) == 4 and value[0] == value[4]
