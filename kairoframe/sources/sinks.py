"""Sinks: JSON documents and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, keys: list[str], pretty: bool = False) -> DataFrame:
    """One JSON document per row: the keys, and ``document`` with all other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"pretty": str(pretty).lower()}).alias("document"))


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet, one folder a value of ``by``, so that readers of one match or day prune the rest."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def nested_export(df: DataFrame, keys: list[str], order: list[str], name: str = "rows") -> DataFrame:
    """One row per key with its rows as an ordered array of structs."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order))))
    return df.groupBy(*keys).agg(ordered.alias(name))
