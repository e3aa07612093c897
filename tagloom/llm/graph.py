"""Connected components of link tables by Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize


class Forest:
    """Union-find over 0..n-1; roots are always flat and the smallest index of their tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        if not (ra != rb).any():
            return
        parent = self.root
        for x, y in np.unique(np.stack([ra, rb], axis=1)[ra != rb], axis=0).tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        while (flat := parent[parent]).tolist() != parent.tolist() if len(parent) < 64 else not np.array_equal(flat := parent[parent], parent):
            parent = flat
        self.root = parent


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join; a hot node is pre-aggregated on its map side and its join is one that
    AQE can split. The loop ends when the links are stars: no node hangs on two
    others, and none that hangs on another has nodes hanging on it. Null nodes
    are left out.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = materialize(links, f"{name}-links")
    while not _are_stars(links):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large, f"{name}-large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        star = small.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("l")).select("l.hi", "l.lo")
        links = materialize(star.where("hi <> lo").distinct(), f"{name}-links")
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _are_stars(links: DataFrame) -> bool:
    ends = links.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    odd = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return odd.isEmpty()
