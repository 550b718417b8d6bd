"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. Large: larger neighbours of u point to its least neighbour. Small: smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge (a, b) reaches; nodes without an edge are left out.
    A round halves the depth of the trees at least; it ends when the edges are stars."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    while True:
        roots = e.select(F.col("v").alias("u")).distinct()
        many = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if e.join(roots, "u", "left_semi").unionByName(e.join(many, "u", "left_semi")).isEmpty():
            break
        e = cut(_star(_star(e, True), False))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
