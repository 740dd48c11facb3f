"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), component being the smallest node of its component.

    Every round links all larger neighbours of a node to the smallest neighbour, then all smaller ones to it, until nothing
    changes; the rounds grow with the logarithm of a component's width. The smallest neighbour comes from an aggregate that
    combines before its shuffle, and is joined back with a plain exchange on the edges' side, which adaptive execution
    splits where a node has very many edges. Rounds end in checkpoints; the driver sees a count and a checksum.
    """
    u, v = F.col("u"), F.col("v")
    same = {"mark": F.bit_xor(F.xxhash64("u", "v"))}

    def small_star(e: DataFrame) -> DataFrame:  # u > v
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").select(F.inline(F.array(F.struct(v.alias("u"), F.col("m").alias("v")),
                                                           F.struct("u", F.col("m").alias("v")))))
        return moved.where("u <> v").distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(v.alias("u"), u.alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v")

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e, before = materialize(e, **same)
    while before["rows"]:
        e, now = materialize(small_star(large_star(e)), **same)
        if (now["rows"], now["mark"]) == (before["rows"], before["mark"]):
            break
        before = now
    return e.select(u.alias("node"), v.alias("component")).unionByName(
        e.select(v.alias("node"), v.alias("component")).distinct())


def local_roots(n: int, a, b):
    """Within a task: for nodes 0..n-1 and the edges a[i]-b[i], the smallest node of each one's component."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root
