"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm.tables import drop_staged, staged


def _is_starry(edges: DataFrame) -> bool:
    """Whether every edge ties a node to its only smaller neighbour, which has none: then nothing is left to contract."""
    ups = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"))
    ends = ups.union(edges.select("lo", F.lit(0))).groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not ends.where("ups > 1 OR ups = 1 AND least = 0").agg(F.count("*").alias("n")).first()["n"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the smallest of its neighbours and itself."""
    least = staged(edges.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least")), "least")
    tied = edges.join(least, "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo"))
    return _written(tied.distinct(), "large", least)


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie the smaller neighbours of each node, and the node, to the smallest of them."""
    least = staged(edges.groupBy("hi").agg(F.min("lo").alias("least")), "least")
    moved = edges.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return _written(moved.union(least.select("hi", F.col("least").alias("lo"))).distinct(), "small", least)


def _written(edges: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """``edges`` staged; what they were made of goes."""
    table = staged(edges, name)
    drop_staged(*used)
    return table


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(hi, lo)`` with ``hi > lo``; root: the smallest reachable node.

    A root is not listed as a node of its own. Each round replaces the edges by as many or fewer; the number
    of rounds grows with the logarithm of the longest path, and edges that are stars take none. Rounds are
    written to the shared folder, so nothing is computed twice and a hub is spread by the skew splitting of
    the plain joins. Rows with null ends, loops and repeated rows are ignored.
    """
    edges = staged(edges.where("hi > lo").select("hi", "lo").distinct(), "edges")
    while not _is_starry(edges):
        large = _large_star(edges)
        drop_staged(edges)
        edges = _small_star(large)
        drop_staged(large)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
