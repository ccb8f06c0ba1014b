"""The subpackage's queries, each an operator applied to its whole table, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.llm import (
    block_search,
    chat_repair,
    decontamination,
    elkan,
    language_crf,
    line_dedup,
    near_dedup,
    packing,
    simhash,
    suffix_index,
    toxicity,
    url_filter,
    whitening,
)
from kairoframe.llm.sampling import held_out
from kairoframe.llm.tables import read

URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(documents, labels.where(~out))
    scored = toxicity.score(documents.withColumn("held_out", out), model)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_sentence", F.size("offending").alias("n_offending")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digests(documents, line_dedup.keep_bitmaps(documents, threshold=10, least_chars=1))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op5_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns in and out, cost, the number of each repair, and an order-sensitive digest of the rendered pieces."""
    turns = chat_repair.rendered(chat_repair.repair(read(spark, sf_dir, "conversations")))
    merged = F.col("action").isin("merge", "relabel_merge").cast("long")
    inserted = (F.col("action") == "insert").cast("long")
    return turns.groupBy("conv_id").agg(
        F.sum(1 - inserted).alias("n_turns"),
        F.sum(1 - merged).alias("n_out"),
        F.sum("cost").alias("cost"),
        F.sum(merged).alias("n_merged"),
        F.sum(F.col("action").isin("relabel", "relabel_merge").cast("long")).alias("n_relabelled"),
        F.sum(inserted).alias("n_inserted"),
        F.bit_xor(F.xxhash64("stretch", "position", "piece")).alias("digest"),
    )


def op7_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_index.removals(documents, suffix_index.repeats(documents, length=400)).drop("spans")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    crf = language_crf.train(documents.where(~out))
    return language_crf.predict(documents.select("doc_id", "text", out.alias("held_out")), crf).select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document."""
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.sum("n_found").alias("n_found"), F.max("reparameterised").alias("reparameterised")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64.0, shift=1_000_000, most=16)


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", width=64, scale=64.0, k=16, rounds=3, seed="1")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, radius=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_block_search": op5_block_search,
    "op6_chat_repair": op6_chat_repair,
    "op7_suffix_index": op7_suffix_index,
    "op8_language_crf": op8_language_crf,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_elkan": op12_elkan,
    "op13_simhash": op13_simhash,
}
