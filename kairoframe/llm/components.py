"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

No step gathers a node's neighbours: each takes the minimum over them (combined before the shuffle) and joins it back. For that join a node is dealt out
over ``SALTS`` tasks by its neighbours' hashes, so that one with very many edges does not land in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoframe.llm.storage import drop_shared, write_shared


SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the w of their u; least: u, w, each u once."""
    salted = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["u", "salt"]).drop("salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v, each once. Large: every node's larger neighbours are tied to its smallest neighbour or itself; small: its
    smaller neighbours and itself to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        tied = _with_least(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("w").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("w"))
        tied = _with_least(edges, least).select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(least.select("u", F.col("w").alias("v")))
    return tied.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has an edge to another one and is not a root itself."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = write_shared(pairs, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, before = mark, now
        now = write_shared(_star(_star(now, True), False), "edges")
        drop_shared(before)
