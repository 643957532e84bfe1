"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import discard, stored

#: Parts over which the neighbours of one node are dealt.
PARTS = 64


def with_least(edges: DataFrame) -> DataFrame:
    """u, v, m for edges u, v: m is the least v of u.

    Minima are taken by node and part of its neighbours first, and joined back by both, so that the neighbours of one node
    are never in one task; a node takes part as often as it has parts, at most ``PARTS`` times.
    """
    # one exchange serves the minima and the join
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("part")).repartition("u", "part")
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts")).select("u", "m", F.explode("parts").alias("part"))
    return dealt.join(least, ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v: of one orderable type); root is the component's smallest node.

    Lineage is cut in every round by a table in the shared folder, which the next round replaces; rounds grow with the
    logarithm of the longest chain, and end when every component is a star.
    """
    pairs = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(pairs):
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        small = with_least(large)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, stored(moved.union(small.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(pairs.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.where("below > 1 OR below = 1 AND above = 1").isEmpty()
