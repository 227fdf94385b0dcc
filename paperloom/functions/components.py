"""Connected components of a small-diameter graph, by labels that take the least one in reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import staged


def components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """``*keys, node, component``: the least node that ``node`` is linked to, for every node with an edge.
    Graphs of different keys are apart. Labels jump to the label of their label, so the number of
    rounds grows as the logarithm of the longest path."""
    both = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(*keys, F.col(b).alias("node"), F.col(a).alias("other"))).filter("node <> other").distinct()
    both = staged(both, "edges")
    now = staged(both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        seen = both.join(now.withColumnRenamed("node", "other"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("component").alias("near"))
        near = now.join(seen, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        of = now.select(*keys, F.col("node").alias("near"), F.col("component").alias("jump"))
        then = staged(near.join(of, [*keys, "near"], "left").select(*keys, "node", "old", F.least("near", F.coalesce("jump", "near")).alias("component")), "labels")
        done = then.filter("old <> component").isEmpty()
        now = then.drop("old")
        if done:
            return now
