"""Connected components of a graph given as a table of edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _linked(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Small: every node links its smaller neighbours, and itself, to the smallest of them. Large:
    every node links its larger neighbours to its smallest neighbour or itself. Only the smallest
    neighbour is computed per node, by partial aggregation; a node with very many edges makes a
    skewed join that adaptive execution splits.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the component's smallest node.

    Each round is written to the shared folder, which cuts the lineage; rounds grow with the
    logarithm of the longest path. Null ends, loops and repeated edges are ignored.
    """
    e = edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now
        e = written(_linked(_linked(e, small=False), small=True), "edges")
