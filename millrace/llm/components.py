"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour. Links are (a, b), a > b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w")
    moved = links.join(least, F.col("a") == F.col("w")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()


def mark(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    ``links`` has two orderable columns. Each round is written to the shared folder; only a count and a checksum
    come to the driver. The number of rounds grows with the logarithm of a component's size.
    """
    a, b = links.columns
    now = materialise(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    seen = mark(now)
    while seen[0]:
        then = materialise(small_star(large_star(now)), "links")
        discard(now)
        now, before, seen = then, seen, mark(then)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
