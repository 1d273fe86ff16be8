"""Connected components of a distributed graph, by alternating large and small stars.

Each round replaces edges by edges to the smallest neighbour; a fixed point is a star for
each component, with the smallest id as its centre. Edges are written to the shared folder
between rounds; only how many there are and the sum of their hashes come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. For each u the smallest of it and its neighbours; then its neighbours (large:
    those above it; small: those below, and itself) are tied to that one."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns id, root for every id with an edge to another one; root is
    the smallest id of its component and stands there itself too."""
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before, old = now, edges
        edges = written(_star(_star(old, True), False), "edges")
        discard(old)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
