"""Connected components of a link table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetloom.llm.common import materialised


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): the smallest node reachable.

    Each round lets every node hand its larger neighbours, then its smaller ones,
    to the smallest node it knows. Minima come from a partial aggregate and the
    links of one node are never gathered, so a hub is no hot task beyond its
    join, which is split by size. Rounds double the reach; links only shrink.
    Nulls and self links are ignored; repeated links count once.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialised(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialised(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialised(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = materialised(least)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialised(small)
        # A forest of stars: every node has one link, and no node that is linked to is itself linked on.
        n, nodes, inner = small.agg(F.count("*"), F.countDistinct("u")).first() + (small.select("v").distinct().join(small.select(F.col("u").alias("v")), "v", "left_semi").count(),)
        links = small
        if n == nodes and inner == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
