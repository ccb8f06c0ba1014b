import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kairoframe.llm.storage import write_shared
from tests.llm.test_near_dedup import brute as near_brute

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    r = random.Random(6)
    rows = []
    for i in range(90):
        lines = [prose(100 * i + k, r.randint(5, 25)) for k in range(r.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(r.randint(0, len(lines)), "Subscribe to our  letter")
        rows.append([i, "\n".join(lines), "aa", "s"])
    bench = [(n, prose(9000 + n, 15)) for n in range(4)]
    for i in (5, 17, 29):
        rows[i][1] += f" {bench[i % 4][1]} and more"
    for i in (7, 8):
        rows.append([100 + i, rows[i][1] + " tail", "aa", "s"])
    rows += [[200, None, "aa", "s"], [201, "12 34 !!", "aa", "s"], [202, "", None, "s"], [203, rows[9][1], "aa", "s"], [None, prose(5, 30), "aa", "s"]]
    out = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_against_brute_force(spark, folder):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = write_shared(stage(spark, docs, folder), "test-stage")
        after = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {200, 201, 202}
        elif name == "line_dedup":
            for r in after:
                kept = [x for x in texts[r.doc_id].split("\n") if x != "Subscribe to our  letter"]
                assert r.text == "\n".join(kept) and r.n_chars == len(r.text)
            assert len(after) == len(before)
        elif name == "near_dedup":
            want = near_brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            assert {r.doc_id for r in after} == {d for d, (_, _, kept) in want.items() if kept} | {None}
            assert {107, 108, 203} & {r.doc_id for r in after} == set()
        elif name == "decontamination":
            clean = lambda t: not any(" ".join(re.findall(r"\w+", b.lower())) in " ".join(re.findall(r"\w+", t.lower())) for b in bench)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if r.doc_id is None or clean(r.text)}
            assert len(after) < len(before)
        else:
            for d, t in texts.items():
                n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
                assert sum(p.length for p in after if p.doc_id == d) == n
            assert np.ptp([p.sequence_id for p in after]) == max(p.sequence_id for p in after)
        if name != "packing":
            assert docs.columns == columns


def test_run_gives_the_last_stage_and_takes_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_further_columns_whose_names_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' AS keep", "1 AS version", "2 AS at", "0.5D AS score", "'x' AS lang_pred", "'k' AS __keep", "3L AS hash", "array('z') AS w", "4L AS rep", "true AS kept")
    docs = write_shared(docs, "test-clash")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_shared(stage(spark, docs, folder), "test-clash")
        assert docs.columns == columns, name
    assert docs.where("keep = 'a' AND version = 1 AND score = 0.5 AND __keep = 'k' AND w[0] = 'z' AND kept").count() == docs.count() > 50
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() > 50
