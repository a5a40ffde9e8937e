"""Connected components of a distributed edge list by alternating large and small stars.

Nothing but one checksum row a round reaches the driver; each round is written to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """``u, v`` with the least neighbour ``m`` of ``u``."""
    least = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return pairs.join(least, pairs["u"] == least["node"]).drop("node")


def _checksum(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min("u"), F.max("v")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two numeric columns) that is not the least of its component."""
    u, v = (F.col(c) for c in edges.columns)
    edges = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "edges")
    before = _checksum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_stars(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = _stars(large)
        small = small.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").where("u > v").distinct(), "edges")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
