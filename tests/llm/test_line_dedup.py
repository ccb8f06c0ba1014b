import hashlib
from collections import defaultdict

from kairoframe.llm import line_dedup

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, threshold, least_chars):
    where = defaultdict(set)
    for row in set(rows):
        for line in (row[1] or "").split("\n"):
            where[line.strip(STRIP).translate(LOWER)].add(row if row[0] is None else row[0])
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(STRIP).translate(LOWER)) < least_chars or len(where[k]) < threshold]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def result(documents, rows, threshold=3, least_chars=1):
    df = documents(rows)
    bitmaps = line_dedup.keep_bitmaps(df, threshold=threshold, least_chars=least_chars)
    return [tuple(r) for r in line_dedup.digests(df.select("doc_id", "text"), bitmaps).collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_against_brute_force(documents, prose):
    rows = [(i, "\n".join([prose(i, 4), "  Common LINE\t", prose(i % 4, 3), "", "É common" if i % 2 else "é common", "common line"])) for i in range(12)]
    assert key(result(documents, rows)) == key(brute(rows, 3, 1))


def test_many_rows_over_many_partitions(documents, spark, prose):
    rows = [(i, f"hot line\nmine {i}\nshared {i % 9}") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for threshold in (10, 45, 400, 401):
            assert key(result(documents, rows, threshold)) == key(brute(rows, threshold, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nulls_empty_repeated_and_long(documents, prose):
    rows = [(1, None), (2, ""), (None, "a\nb"), (3, "a\nb"), (3, "a\nb"), (4, "a"), (5, "\n\n"), (6, "a\n" * 3000), (7, "\x1fa\x1f"), (8, " ")]
    assert key(result(documents, rows)) == key(brute(rows, 3, 1))
    assert key(result(documents, rows, 2, 2)) == key(brute(rows, 2, 2))


def test_empty_table(documents):
    assert result(documents, []) == []


def test_applied_to_texts(documents):
    rows = [(i, f"own {i}\nSame") for i in range(5)]
    df = line_dedup.without_repeated_lines(documents(rows), threshold=5)
    assert df.columns == documents(rows).columns
    assert sorted((r.doc_id, r.text) for r in df.collect()) == [(i, f"own {i}") for i in range(5)]


def test_rows_of_one_id_count_once_whatever_their_texts(documents, spark):
    rows = [(i, f"one {i} {v}\ncommon") for i in range(5) for v in "ab"] + [(None, f"{i}\nnameless") for i in range(6)]
    for threshold in (5, 6, 7, 10):
        assert key(result(documents, rows, threshold)) == key(brute(rows, threshold, 1))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert key(result(documents, rows * 2, 6)) == key(brute(rows * 2, 6, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lines_that_collide_modulo_powers_of_two(documents):
    line = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(i, line if i < 5 else line.translate(str.maketrans("ab", "ba"))) for i in range(10)]
    assert key(result(documents, rows, 10)) == key(brute(rows, 10, 1))


def test_ids_of_another_type_and_clashing_columns(spark):
    df = spark.createDataFrame([(str(i), f"own {i}\nSame", "k", "v") for i in range(5)], "doc_id string, text string, __keep string, __version string")
    kept = line_dedup.without_repeated_lines(df, threshold=5)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(str(i), f"own {i}", "k", "v") for i in range(5)]
