import random
import re

import numpy as np
import pytest
import xxhash

from kairoframe.llm import queries, simhash
from kairoframe.llm.bytetext import text_bytes
from kairoframe.llm.tables import read


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(len(words) - size + 1, min(len(words), 1)))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2, size=3):
    """Each row's fingerprint, and the smallest id reachable over pairs of fingerprints."""
    prints = [fingerprint(t, size) for _, t in rows]
    group = {p: p for p, (i, _) in zip(prints, rows) if i is not None}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= radius:
                group[find(a)] = find(b)
    least = {}
    for p, (i, _) in zip(prints, rows):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{p:016x}", None if i is None else least[find(p)]) for p, (i, _) in zip(prints, rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_against_all_pairs(spark, documents, prose):
    r = random.Random(1)
    rows = [(i, prose(i, r.randint(5, 400))) for i in range(60)]
    for i in range(60, 300):
        words = rows[r.randrange(i)][1].split(" ")
        for _ in range(r.choice([0, 1, 1, 2])):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    r.shuffle(rows)
    want = brute(rows)
    assert got(simhash.near_duplicates(documents(rows).repartition(5))) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}) < 300


def test_texts_of_all_kinds(spark, documents):
    texts = [None, "", " \n\t", "one", "One", "one two", "ONE  two\x0b", "one two three", "ä b c d", "x" * 50_000, "word " * 30_000, "a b c " * 3, "É é e", "\x00 a \x1f"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (None, None), (3, "one"), (5, "other words of that id"), (99, "one")]
    want = brute(rows)
    assert got(simhash.near_duplicates(documents(rows))) == want
    assert [f for i, f, _ in want if i in (0, 1, 2)] == ["0" * 16] * 3
    assert got(simhash.near_duplicates(documents([]))) == []


def test_a_third_of_all_rows_alike_and_a_large_group_of_near_copies(spark, documents, prose):
    base = prose(9, 300).split(" ")
    rows = [(i, "the same text everywhere") for i in range(200)]
    for i in range(200, 400):
        words = list(base)
        words[i % 297] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, prose(i, 50)) for i in range(400, 600)]
    assert got(simhash.near_duplicates(documents(rows))) == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_at_every_radius(spark, radius):
    """Chains of fingerprints around few centres: the components are those of all pairs."""
    r = random.Random(radius)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in set(r.choices(range(64), k=r.randint(0, 4)))) for c in centres for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(a, b) for a, b in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius).collect()}
    assert all((a ^ b).bit_count() <= radius or ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in found)

    def components(edges):
        root = {s: s for s in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in signed if find(y) == find(x)) for x in signed}

    assert components(found) == components((a, b) for a in signed for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius)
    masks, inner = simhash.ball(radius)
    assert len(masks) == {0: 1, 1: 65, 2: 65, 3: 2081}[radius] and inner.sum() == {0: 1, 1: 1, 2: 65, 3: 65}[radius]


def test_hashes_are_counted_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "PART", 5)
    texts = ["a b c d e f g h i j k l m", None, "x", "p q r s t u v w x y z", "  "]
    assert simhash.fingerprints_of(*text_bytes(pa.array(texts)), 3).tolist() == [fingerprint(t) for t in texts]
    assert simhash.fingerprints_of(np.zeros(0, np.uint8), np.zeros(1, np.int64), 3).tolist() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in read(spark, folder, "documents").select("doc_id", "text").collect()]
    assert got(queries.op13_simhash(spark, folder)) == brute(rows)
