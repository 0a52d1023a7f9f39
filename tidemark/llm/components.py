"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _mark(edges: DataFrame):
    """Number and order-free hash of the edges: equal when nothing changed."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (u, v)``; the label is the smallest node reachable.

    Each round hangs neighbours under the smallest one known; paths shrink by half or so a
    round.  Per node only a minimum is aggregated, so a node with very many links is no problem,
    and each round is written, which cuts the lineage.
    """
    edges = materialise(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    )
    mark = None
    while mark != (mark := _mark(edges)):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        under = large.join(least, "u")
        small = under.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(under.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u != v").distinct())
    # every edge now leads to the smallest node of its component
    leaves = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = leaves.select(F.col("label").alias("node"), "label").distinct()
    return leaves.unionByName(roots)
