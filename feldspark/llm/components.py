"""Connected components of an edge table, by shrinking stars in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


ROWS_PER_TASK = 100_000


def tasks_for(rows: int) -> int:
    """Tasks for the rows there are: many near-empty ones would cost more, in files and time, than the work."""
    return max(1, -(-rows // ROWS_PER_TASK))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges``.

    Each round links every larger neighbour of a node to the smallest node next to it, then
    every node and its smaller neighbours likewise, until nothing changes. No group is ever
    collected: the smallest neighbour is an aggregate, and the links come from a join. The
    rounds are checkpointed, so a lost executor repeats one round at most.
    """
    links = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    size = _fingerprint(links)
    while True:
        tasks = tasks_for(size[0])
        links = _large_star(links.coalesce(tasks)).coalesce(tasks)
        links = cut_lineage(_small_star(links, tasks).coalesce(tasks))
        before, size = size, _fingerprint(links)
        if size == before:
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(smallest, "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(smallest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smallest.select("u", F.col("m").alias("v")).unionByName(moved).coalesce(tasks).distinct()
