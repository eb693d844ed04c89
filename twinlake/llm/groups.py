"""Consolidating pairwise links into groups: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.operators.heavykeys import running_offsets
from twinlake.session import cut, drop_cut


def node_id(kind: str, c) -> F.Column:
    """16-byte node key of a value; a digest, so equal keys of different values don't occur in practice."""
    return F.unhex(F.md5(F.concat(F.lit(kind + ":"), c.cast("string"))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), "m")
    # A node without smaller neighbours is its own minimum: its edges stay as they are.
    return edges.join(least, F.col("lo") == F.col("node"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), "m")
    inner = edges.join(least, F.col("hi") == F.col("node")).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return inner.unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo")))


def _leaves_marked(edges: DataFrame) -> DataFrame:
    """``edges`` with ``leaf``: whether the larger node has no other edge, so that it stays with the smaller one whatever comes."""
    ends = edges.groupBy("hi").agg(F.count("*").alias("n")).select(F.col("hi").alias("node"), "n", F.lit(0).alias("above")).unionByName(edges.select(F.col("lo").alias("node")).distinct().select("node", F.lit(0).alias("n"), F.lit(1).alias("above")))
    leaves = ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("above").alias("above")).filter("n = 1 AND above = 0").select("node", F.lit(True).alias("leaf"))
    return edges.join(leaves, F.col("hi") == F.col("node"), "left").select("hi", "lo", F.coalesce("leaf", F.lit(False)).alias("leaf"))


def star_centres(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, group)`` of each node of ``edges (hi, lo)``, hi > lo, but for the smallest ones of their components.

    A round rewrites the edges by large-star and small-star, each a grouped minimum joined back by
    node. A node left with one edge, to a smaller node, can't change any more but with that node: it is put
    by with it, and rounds go on over the other edges until none is left. So rounds grow with the logarithm
    of the longest chain, and what they rewrite shrinks with each. Then the nodes put by take the group of
    the node they are with, last round first.

    Each round is one write to the checkpoint folder, which cuts lineage and survives the loss of
    executors; the edges of the round before are deleted once it is written, so the folder holds each node
    about once. The driver gets nothing but whether edges are left. The joined minima have one row a node,
    so a node with a large share of all edges is split by adaptive skew handling.
    """
    todo, written, leaves = edges, [], []
    for _ in range(rounds):
        marked = cut(_leaves_marked(_small_star(_large_star(todo).distinct()).distinct()))
        for df in written:
            drop_cut(df)
        leaves.append(cut(marked.filter("leaf").select("hi", "lo")))
        todo, written = marked.filter("NOT leaf").select("hi", "lo"), [marked]
        if todo.isEmpty():
            break
    else:
        raise RuntimeError(f"links aren't consolidated after {rounds} rounds")
    drop_cut(marked)
    found = leaves[-1].select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    for i in range(len(leaves) - 2, -1, -1):
        mine = leaves[i].join(found, F.col("lo") == F.col("node"), "left").select(F.col("hi").alias("node"), F.coalesce("group", "lo").alias("group"))
        found = cut(mine.unionByName(found)) if i else mine.unionByName(found)
    return found


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, group)``: every node of ``pairs`` with the smallest node it is linked to, directly or not.

    Edges run from the larger to the smaller node and are consolidated by ``star_centres``. Pairs with a
    null end link nothing; a pair of equal ends makes its node a group of one. Empty input gives no rows.
    """
    ends = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = cut(ends.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    stars = star_centres(edges, rounds).select(F.col("node").alias("member"), F.col("group").alias("least"))
    return nodes.join(stars, F.col("node") == F.col("member"), "left").select("node", F.coalesce("least", "node").alias("group"))


def consolidated(df: DataFrame, member: str = "path", group: str = "group_id", label: str = "group_path") -> DataFrame:
    """``(member, label)``: each distinct member with the smallest member linked to it over shared groups.

    Members are numbered in their order, so that rounds move numbers and the smallest number of a component
    is its smallest member. A group of any size gives one edge a member, to its smallest member, and
    none of its pairs are made. A null member links nothing and isn't returned; a null group links nothing,
    its members are returned with what links them otherwise, or alone. Empty input gives no rows.
    """
    rows = cut(df.select(F.col(member).alias("m"), F.col(group).alias("g")).filter("m IS NOT NULL").distinct())
    ordered = cut(rows.select("m").distinct().orderBy("m"))
    names = cut(running_offsets(ordered.withColumn("_all", F.lit(0)), ["_all"], order=[F.col("m")], out="id").select("id", "m"))
    drop_cut(ordered)
    links = cut(rows.filter("g IS NOT NULL").join(names.select(F.col("m").alias("of"), "id"), F.col("m") == F.col("of")).select("id", "g"))
    drop_cut(rows)
    least = links.groupBy("g").agg(F.min("id").alias("lo")).select(F.col("g").alias("lg"), "lo")
    edges = links.join(least, F.col("g") == F.col("lg")).filter("id != lo").select(F.col("id").alias("hi"), "lo").distinct()
    stars = star_centres(edges).select(F.col("node"), F.col("group"))
    found = names.join(stars, F.col("id") == F.col("node"), "left").select("m", F.coalesce("group", "id").alias("group"))
    return found.join(names.select(F.col("id").alias("first"), F.col("m").alias(label)), F.col("group") == F.col("first")).select(F.col("m").alias(member), label)
