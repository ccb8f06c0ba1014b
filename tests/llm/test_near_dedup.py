import random
from itertools import combinations

import pytest

from kairoframe.llm import components, near_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text, size):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    w = [x for x in text.translate(LOWER).split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = {d: shingle_set(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d), d == find(d)) for d, s in sets.items()}


def found(documents, rows, size=3, percent=85):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(rows), size=size, percent=percent).collect()}


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_groups_of_copies_against_brute_force(documents, prose, size, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(5)
    rows, n = [], 0
    for group in (60, 7, 3, 2):
        base = prose(group, 150)
        for _ in range(group):
            rows.append((n, edited(base, r.choice([0, 1, 2, 4, 8]), r)))
            n += 1
    common = prose(99, 40)
    rows += [(n + i, f"{prose(1000 + i, r.randint(1, 90))} {common}") for i in range(40)]
    r.shuffle(rows)
    assert found(documents, rows, size, percent) == brute(rows, size, percent)


def test_short_texts_and_ties(documents):
    texts = [None, "", " \t\n", "a", "A", "a b", "a  b", "a b c", "a b c d", "b a", "\x1fa", "É é é", "é é é", "x " * 500, "x x x"]
    rows = list(enumerate(texts))
    assert found(documents, rows) == brute(rows, 3, 85)


def test_rows_without_id_repeats_and_empty_table(documents):
    got = near_dedup.near_duplicates(documents([(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 1, False), (2, 1, False)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, None)]
    assert found(documents, []) == {}


def test_one_of_each_group_stays(documents, prose):
    base = prose(1, 200)
    rows = [(5, base), (3, base + " end"), (9, prose(2, 50)), (None, base), (7, None), (8, None)]
    kept = near_dedup.deduplicated(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 8, 9]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(120)] + [(1000, 1001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
