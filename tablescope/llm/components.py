"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _downward(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: rows ``a``, ``b``. Rows ``node``, ``root`` for every node that is not its component's smallest.

    Each round joins edges with one minimum per node, made by partial sums, so a node with very
    many edges is only a skewed join, which adaptive execution splits. Rounds end when the edge
    table stays the same; it is written after each.
    """
    now = written(_downward(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = _downward(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")))
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(least, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        now = written(_downward(small.unionByName(least.select("u", F.col("_m").alias("v")))), "small-star")
