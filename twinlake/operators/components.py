"""Connected components for the near-duplicate passes: smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``(node, component)`` of every node in an edge, with the smallest node it is connected to.

    Each round takes the smallest label of the neighbours and then the label's own label, so long
    chains shorten by half. Labels are written to the checkpoint folder each round; the rounds end
    when no label changes. Null ends are ignored.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    for _ in range(rounds):
        theirs = labels.select(F.col("a").alias("n"), F.col("l").alias("nl"))
        near = both.join(theirs, F.col("b") == F.col("n")).groupBy("a").agg(F.min("nl").alias("m")).select(F.col("a").alias("ma"), "m")
        step = labels.join(near, F.col("a") == F.col("ma")).select("a", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        up = step.select(F.col("a").alias("u"), F.col("l").alias("ul"))
        step = cut(step.join(up, F.col("l") == F.col("u")).select("a", F.least("l", "ul").alias("l"), "was"))
        labels = step.select("a", "l")
        if step.filter("l != was").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"components still change after {rounds} rounds")
