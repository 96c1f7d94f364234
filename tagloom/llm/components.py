"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node
    that can be reached. Self loops are allowed, null ends are ignored.

    Each round is two aggregations and two joins on the node; a large neighbourhood is
    only ever reduced to its minimum, never gathered. Stars need two rounds, other
    shapes a logarithmic number."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = stage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    links = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stage(links, "cc-links")
    size = None
    while True:
        # large star: every larger neighbour is linked to the node's smallest neighbour
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "cc-large")
        # small star: every smaller neighbour, and the node, is linked to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        links = stage(small, "cc-small")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    roots = links.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("m", "node").alias("component"))
