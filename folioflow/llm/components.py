"""Connected components over an edge table, without collecting any of it.

Alternating large-star and small-star rounds: each round replaces the links of a node by
links to the smallest neighbour, and the edge set ends as one star per component. Minima
are hash aggregates, so a hub's neighbours are combined before the shuffle; the join that
brings a node's minimum back to its links is an ordinary equi-join, whose hot keys adaptive
execution splits. Every round ends in a table in the shared folder, so a lost executor
costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges a > b."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    linked = met.where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("x"), "m")
    if not large:
        linked = linked.unionAll(least.select(F.col("u").alias("x"), "m"))
    return linked.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b): node ids in either order. Returns (node, component), component being the
    smallest node reachable; nodes without links are absent. Nulls and self-links are dropped,
    repeated links count once, an empty table gives an empty table.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = written(links, name), None
    while True:
        rounds = written(_star(_star(links, True), False), name)
        discard(links)
        links = rounds
        n, mark = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if n == 0 or (n, mark) == seen:
            break
        seen = (n, mark)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
