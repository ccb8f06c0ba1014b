import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kairoframe.llm import packing

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,abst1é\x1c\u00a0\u3000"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_parts_encode_like_whole_texts(texts):
    t = packing.encoder(PATH).tokenizer
    ids, bounds = packing.encoder(PATH)(pa.array(texts, pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_round_trip(documents, plain, prose):
    rows = [(i, prose(i, 5 * i)) for i in range(40)] + [(40, None), (41, ""), (42, prose(7, 3000)), (43, "same"), (43, "same"), (None, "no id")]
    pieces = packing.pack(documents(rows), PATH, length=64).collect()
    want = sorted((r[0] if r[0] is not None else -1, len(plain(r[1])) + 1) for r in rows)
    # Sequences are full but for the last, without gap or overlap.
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == len(by_sequence) - 1
    # Pieces of a document, in order, are its ids.
    texts = {d: t for d, t in rows}
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id, p.start)):
        ids = plain(texts[p.doc_id]) + [1]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert sorted((d if d is not None else -1, n) for d, n in whole.items() if d != 43) == [w for w in want if w[0] != 43]
    assert whole[43] == 2 * (len(plain("same")) + 1)


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []


def test_ids_of_another_type_and_clashing_columns(spark, plain):
    rows = [("a", "one two", 1, "x"), (None, "three", 2, "y"), ("a", None, 3, "z")]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id string, text string, part int, ids string"), PATH, length=4)
    assert pieces.schema["doc_id"].dataType.simpleString() == "string"
    got = {}
    for p in pieces.collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {"a": len(plain("one two")) + 2, None: len(plain("three")) + 1}
