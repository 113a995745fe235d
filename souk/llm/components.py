"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import drop_table, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or smaller and larger ones; if none has, every component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    nodes = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return nodes.agg(F.max(F.expr("smaller > 1 OR smaller = 1 AND larger = 1"))).first()[0] is True


def connected_components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another.

    ``edges`` has long columns ``u`` and ``v`` in any order; loops and nulls are ignored. Each round is
    two group-by-minimum joins over the edges, written to the shared folder; the rounds end
    when all components are stars, and their number grows with the logarithm of the nodes."""
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), purpose)
    while _unsettled(now):
        before = now
        now = materialise(_small_star(_large_star(now)), purpose)
        drop_table(before)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
