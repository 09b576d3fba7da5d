"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is one minimum per node (combined before the shuffle) and one join; no neighbourhood is gathered. Edges
are staged in the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    joined = both.join(_least(both), F.col("u") == F.col("k")).where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    joined = down.join(_least(down), F.col("u") == F.col("k"))
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node of ``edges(u, v)`` but the smallest of its component, with that smallest node."""
    current = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        current = stage(_small_star(_large_star(current).distinct()), "stars")
        mark = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(hash(v, u) as decimal(20)))")).first()
        if mark == seen:
            return current
        seen = mark
