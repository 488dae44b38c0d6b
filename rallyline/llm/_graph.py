"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyline.llm._base import Scratch


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b), component being the smallest node.

    Each round hangs every node's larger neighbours under its smallest neighbour (large
    star), then every node's smaller neighbours and itself likewise (small star). Edges
    never grow in number, the longest path shrinks by a constant factor, and rounds end
    when the edges are stars. Smallest neighbours come from an aggregation (combined
    before the shuffle), so a node with very many links fills no single task; rounds
    are written to the shared folder. Links between equal nodes, repeated links and
    links with null are left out.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.write(edges, "edges")
    before = _print(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rest = low.select("a", F.col("m").alias("b"))
        after_edges = scratch.write(small.unionByName(rest).distinct(), "edges")
        after = _print(after_edges)
        scratch.drop(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
