"""Connected components of a table of links: alternating large-star and small-star rounds.

Each round is a join on a node and a minimum per node. Minima are pre-aggregated before they are shuffled, and a node's links are
dealt to SPLIT tasks for the join, as a hub may hold a third of all; nothing is gathered. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPLIT = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with u's least (u, m)."""
    parts = least.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    # neither side has a size bound, and the parts are more than their statistics say: a merge join at every size
    return links.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(SPLIT)).cast("int")).join(parts.hint("merge"), ["u", "_part"])


def components(links: DataFrame, tag: str = "links") -> DataFrame:
    """links: a, b (long). Returns node, component (the smallest node reachable) for each node with a link to another."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), tag)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each neighbour above u is linked to the least of u's surroundings
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, tag)
        # small star: u and its lower neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _with_least(large, least)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, tag)
        # done when every node has one parent and no parent has a parent
        tops = small.select(F.col("v").alias("u"))
        if not small.groupBy("u").count().where("count > 1").limit(1).count() and not small.join(tops, "u", "left_semi").limit(1).count():
            break
        edges = small
    roots = small.select(F.col("v").alias("node")).distinct()
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
