"""Connected components of a relation of edges, as DataFrame rounds.

Edges first shrink to spanning forests within their partitions; then large-star
and small-star rounds (Kiveris et al., 2014) pull every node to the smallest id
of its component. Each round is written to the shared folder, so that lineage
stays short and a lost executor costs one round. Only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

EDGES = "a long, b long"


class Forest:
    """Union-find over arbitrary integer ids; the smallest id is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def local_forest(batches):
    """A partition's edges as stars (node, smallest node it reaches here); emptied and begun anew past a million nodes."""

    def stars(forest):
        nodes = [x for x in forest.parent if forest.find(x) != x]
        if nodes:
            yield pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([forest.find(x) for x in nodes], pa.int64())})

    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(x, y)
        if len(forest.parent) > 1_000_000:
            yield from stars(forest)
            forest = Forest()
    yield from stars(forest)


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges with a > b: the neighbours of each node go to its smallest neighbour."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
    if large:
        # a hub's neighbours may be many: both sides are shuffled for the join, so that a hot node can be split
        least = least.select((F.col("k") + F.lit(0)).alias("k"), "m")
        out = near.join(least, near.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = least.select((F.col("k") + F.lit(0)).alias("k"), "m")
        out = near.join(least, near.a == least.k).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()



def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node that has an edge to another one; the component is its smallest id."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = runtime.written(edges.mapInArrow(local_forest, EDGES).distinct(), name)
    while True:
        # finished when every node has one edge and no node is both a root and a child
        again = edges.groupBy("a").agg(F.count("*").alias("n"))
        roots = edges.select(F.col("b").alias("a")).distinct()
        if edges.isEmpty() or (again.where("n > 1").isEmpty() and again.join(roots, "a", "left_semi").isEmpty()):
            break
        edges = runtime.written(star(star(edges, True), False), name)
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
