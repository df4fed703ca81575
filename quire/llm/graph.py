"""Connected components by alternating star contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def joined(links: DataFrame, minima: DataFrame) -> DataFrame:
    """Links with the minimum of their ``u``. A second key keeps Spark from reusing the partitioning of the aggregation,
    under which a skewed ``u`` could not be split."""
    key = F.xxhash64("u")
    return links.withColumn("k", key).join(minima.withColumn("k", key), ["k", "u"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Label every linked node with the smallest node that it can reach: columns ``node``, ``label``.

    Each round applies a large-star step (link a node's larger neighbours to its smallest neighbour) and a
    small-star step (link its smaller neighbours to the smallest), then writes the links. Minima are combined
    before the shuffle, and minima and links are joined by exchanges of their own, so that adaptive execution can split
    the links of a hub that has a third of them. Rounds grow
    with the logarithm of the longest path; ``rounds`` only guards against an endless loop and raises.

    Nulls and self-links are ignored; an empty table gives an empty table.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges, before = written(edges, "links"), None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: every larger neighbour v of u goes to the least of u's neighbourhood
        large = joined(both, low).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            joined(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        after = written(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return nodes.unionByName(roots)
