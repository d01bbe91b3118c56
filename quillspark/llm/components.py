"""Connected components by alternating large and small stars (Kiveris et al., 2014), as DataFrame joins.

Each round points every vertex at the least vertex near it; rounds grow with the logarithm of a component's width. Each
round's edges are written to the shared folder, so lineage stays short and nothing is gathered on the driver but two
numbers a round. A hub is one side of a plain sort-merge join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _least(ws: Workspace, edges: DataFrame) -> DataFrame:
    """The least neighbour of each u. Written, so that the join with it shuffles both sides and can split a hub."""
    return ws.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(ws: Workspace, edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(ws, both)
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(ws: Workspace, edges: DataFrame) -> DataFrame:
    """edges: u > v in each row."""
    least = _least(ws, edges)
    joined = edges.join(least, "u")
    linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(ws: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u long, v long) in either direction: (node, root), root being the component's least vertex. Self-links and repeats are allowed."""
    now = ws.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        large = ws.keep(_large_star(ws, now), "large")
        after = ws.keep(_small_star(ws, large), "small")
        ws.drop(now, large)
        now, digest = after, _digest(after)
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
    # At the fixed point every edge leads to its component's least vertex.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
