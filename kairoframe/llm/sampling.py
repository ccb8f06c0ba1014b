"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_bytes(rows: DataFrame, key: str, most_bytes: int, seed: int = 7, text: str = "text") -> DataFrame:
    """Of a bounded number of rows, in the order of their keys' hashes, those that fit with all before them into most_bytes of text."""
    so_far = F.sum(F.coalesce(F.octet_length(text), F.lit(0))).over(Window.orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("so_far")


def bounded_sample(rows: DataFrame, key: str, most: int, most_bytes: int, seed: int = 7, text: str = "text") -> DataFrame:
    """The rows of at most ``most`` keys, those with the smallest hashes, as far as they fit into most_bytes. Only the chosen keys, a bounded number, are sent around."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most)
    return within_bytes(rows.join(F.broadcast(keys), key), key, most_bytes, seed, text)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls into the fold (a null id never does)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
