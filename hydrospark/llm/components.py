"""Connected components of a link table by label exchange, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.shared import staged


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), v smaller, are stars: every u has one v, and no v is a u.

    A round moves the edges of all other graphs to smaller nodes, and none of stars.
    """
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return not (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
                .where("up > 1 or up = 1 and down = 1").limit(1).count())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest reachable node.

    Alternating star contraction: each round hangs the larger neighbours of a node on its smallest
    one (large star), then the smaller neighbours and the node on the smallest (small star). Edges
    never grow in number and the rounds are logarithmic in the longest path. A star's centre may
    have any number of leaves, but rows are only reduced to a minimum per node, so that no list
    of neighbours is ever held. Each round is written to the shared folder.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = staged(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
