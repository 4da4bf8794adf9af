"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that has an edge; ``component`` is the smallest node it reaches.

    ``edges`` has long columns ``a`` and ``b``; loops, repeats and nulls are allowed.  Alternates two
    steps that both keep connectivity: every node passes its smallest neighbour to its larger
    neighbours, then to its smaller ones.  Rounds grow with the logarithm of the number of nodes.
    Minima come from grouped aggregation (summed before the shuffle) and joins, so a hub with very many
    neighbours is split by the join's skew handling; edges stay in tables.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialise(links, "links")
    mark = _mark(links)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = _mark(links)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def extend_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` after further ``edges`` (a, b): only the components that these join are worked on again."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joins = materialise(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "component-links")
    if joins.isEmpty():
        return roots
    joined = connected_components(joins)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("_new"))
    old = roots.join(moved, "component", "left").select("node", F.coalesce("_new", "component").alias("component"))
    return materialise(old.union(joined.join(roots.select("node"), "node", "left_anti")), "components")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first()
    return tuple(row)
