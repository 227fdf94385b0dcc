"""Connected components of an edge table by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _key(edges: DataFrame) -> tuple:
    """Equal for equal tables; whole numbers, as their sum doesn't depend on the order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Each round links the larger neighbours of a node to its smallest one, then the smaller ones
    likewise; the number of rounds grows as the logarithm of the longest path. Minima are taken
    before the shuffle, so the centre of a star costs one row per task. Edges with a null end and
    edges from a node to itself join nothing; repeated edges count once.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = written(edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    key = _key(now)
    while key[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        then = written(small.select("e.*").filter("u <> v").distinct(), "edges")
        before, key, now = key, _key(then), then
        if key == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
