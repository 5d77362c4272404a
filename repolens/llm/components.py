"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest of a node and its neighbours ``v``. Combined before the shuffle."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_smallest(both), "u").filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    linked = down.join(_smallest(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(_smallest(down).select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the ``(u, v)`` edges; the root is the component's smallest node.

    Alternates large and small stars until nothing changes, in about as many rounds as the logarithm
    of the number of nodes. Each round is written to the shared folder; only two numbers come to the driver.
    Null ends are not allowed; loops and repeated edges do no harm; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
