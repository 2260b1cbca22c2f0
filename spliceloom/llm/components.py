"""Connected components by alternating large-star and small-star steps on DataFrames.

The links of a hub, a node of very many links, are dealt out to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import join_dealt
from spliceloom.staging import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("times"))
    least = written(least.select("u", F.least("u", "m").alias("m"), "times"), "least")
    moved = join_dealt(both.where("v > u"), least.select("u", "m"), "u", least)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges run from u to a smaller v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")), "least")
    moved = join_dealt(edges, least.select("u", "m"), "u", least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The least node reachable from each linked node: columns node, root.

    Nodes without a link are absent; null ends, self links and repeated links are ignored. Only the
    count and a hash of the links reach the driver, to see when a round changes nothing.
    """
    edges = pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = written(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
