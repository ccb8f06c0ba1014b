"""A training corpus from raw documents: five stages, each a filter or transformation on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and rereads for the next stage. All
but the last return the columns of documents, whatever further ones there are and whatever their names.

In every stage a null text is an empty one, a text may be of any length below 2 GB, rows given twice are treated alike, and an empty table gives an empty
one. Where a stage has to choose among equals it says how.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.llm import decontamination, language_crf, line_dedup, near_dedup, packing
from kairoframe.llm.sampling import held_out
from kairoframe.llm.storage import drop_shared, write_shared
from kairoframe.llm.tables import read

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no known language: no letter (null and empty texts too), or no language with half of the words' marginals; equal
    shares go to the language that sorts first. The field is fitted on the documents' own labels, the same folds left out as in op8; without
    labels no language is known and no document stays."""
    crf = language_crf.train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), 4, 2)))
    return language_crf.known(docs, crf, least=0.5)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key is in at least 10 documents go, in every document. A document stays, if with an empty text; rows that share an id count
    once, rows without an id by their texts."""
    return line_dedup.without_repeated_lines(docs, threshold=10, least_chars=1)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: shingles of five words, similarity 0.8. Documents without words, or without an id,
    are in no group and stay; rows that share an id are one document."""
    return near_dedup.deduplicated(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of their ids; documents without an id stay."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 2048 tokens, in the order of the input's partitions; rows given twice are packed twice."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: The language model, the sketches and the tokenizer have no SQL form: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the pieces of the packed sequences."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = write_shared(stage(spark, docs, sf_dir), f"stage-{i}-{name}")
        if i:
            drop_shared(docs)
        docs = done
    return docs
