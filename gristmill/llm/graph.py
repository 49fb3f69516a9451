"""Connected components by alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: hang neighbours of each node on its smallest neighbour.

    The large star moves the larger neighbours, the small star the smaller ones
    and the node itself. Both keep components as they are and only shorten paths.
    """
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("low")).withColumn("low", F.least("low", "n"))
    moved = both.join(least, "n")
    if large:
        out = moved.filter("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = moved.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root) of every node that has an edge; root is the component's smallest id.

    ``edges`` has two long columns u and v. Each round is written to the shared
    folder; the rounds needed grow with the logarithm of the longest path.
    """
    edges = settle(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        edges = settle(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
