"""Thin readers of the synthetic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def number(df: DataFrame, name: str) -> Column:
    """A long that stands for the id in column ``name``: whole numbers as they are, other types by a 64-bit hash. Null stays null."""
    kind = df.schema[name].dataType.simpleString()
    return F.col(name).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(name).isNotNull(), F.xxhash64(name))


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds (null id: null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % folds
