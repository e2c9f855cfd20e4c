"""Connected components of link tables, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlens.session import checkpointed


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node in ``links``; the root is the smallest node of its component.

    Large-star and small-star steps by turns, until the links of a round are those of the round before; the
    number of rounds grows with the logarithm of the nodes. Null ends and links to itself are left out.
    """
    edges = checkpointed(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where("a is not null and b is not null and a <> b").distinct()
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        met = larger.join(least, "a")
        edges = checkpointed(
            met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
