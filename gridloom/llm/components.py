"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A guard against endless rounds only: the rounds grow with the logarithm of the longest chain.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. large: hang every larger neighbour on the smallest of the neighbourhood; else every smaller one and the node itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("a <> m").select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that `links` (a, b: long) joins to a smaller one; root is the smallest node of its component.

    Each round's links are written to the shared folder, so a lost executor costs one round at most.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        edges = materialize(_star(_star(edges, large=True), large=False), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
