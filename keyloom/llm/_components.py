"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._frames import durable


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to node, root: the smallest node of its component; roots and lone nodes have no row.

    Each round rewires every node's larger neighbours, then its smaller ones, to the smallest it knows; the
    number of edges never grows, and the rounds grow with the logarithm of a component's size.
    """
    found = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _signature(found)
    while mark[0]:
        both = found.select(F.col("u").alias("x"), F.col("v").alias("y")).union(found.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = durable(small.union(low.select("u", "m")).distinct())
        mark, before = _signature(found), mark
        if mark == before:
            break
    return found.select(F.col("u").alias("node"), F.col("v").alias("root"))
