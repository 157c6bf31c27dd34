"""Connected components by alternating large-star and small-star rounds.

Edges are rewired towards each node's least neighbour until every component is a star
around its least node. Each round is a few joins and aggregates over the edge table, which
is written to the shared folder, so no component, however large, is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two tables without repeated rows are equal."""
    return x.count() == y.count() and x.join(y, ["u", "v"], "left_anti").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it is connected to, of every node of ``edges`` (u, v).

    Self-loops and repeated edges are harmless; nodes without an edge have no row. Ends with
    the first round that changes nothing, after about log(nodes) ones.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not now.isEmpty():
        new = cut(_small_star(_large_star(now)))
        settled = _same(now, new)
        drop(now)
        now = new
        if settled:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
