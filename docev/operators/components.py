"""Connected components of edges between numbers.

Edges are dealt to groups of about ``LOCAL``; each group replaces its own by stars about its components' smallest nodes,
in numpy. What is left of them goes to one group once that is small enough; before, rounds of large and small stars
(each node's edges move to its smallest neighbour) shrink it, as many as the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session

LOCAL = 1_000_000


def smallest(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of n members the smallest index that edges lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[one], root[other])
        least = root.copy()
        np.minimum.at(least, root[one], low)
        np.minimum.at(least, root[other], low)
        while (least[least] != least).any():
            least = least[least]
        if (least == root).all():
            return root
        root = least


def _stars(table: pa.Table) -> pa.Table:
    nodes, at = np.unique(np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
    half = len(at) // 2
    root = smallest(len(nodes), at[:half], at[half:])
    return pa.table([pa.array(nodes), pa.array(nodes[root])], names=["u", "v"])


def _local(edges: DataFrame, groups: int, scratch: session.Scratch) -> DataFrame:
    dealt = edges.withColumn("g", F.pmod(F.xxhash64(F.greatest("u", "v")), F.lit(groups)))
    return scratch.table(dealt.groupBy("g").applyInArrow(_stars, "u long, v long"))


def components(edges: DataFrame, local: int = LOCAL, scratch: session.Scratch | None = None) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, of every node of the edges (u, v: long); a table of ``scratch``."""
    scratch = scratch or session.Scratch(edges.sparkSession, "components")
    first = scratch.table(edges.select("u", "v").distinct())
    groups = max(1, -(-first.count() // local))
    held = _local(first, groups, scratch)
    scratch.drop(first)
    while groups > 1:
        pairs = scratch.table(held.where("u != v").distinct())
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(near, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        after = scratch.table(small.distinct())
        state = lambda frame: tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        same, left = state(after) == state(pairs), after.count()
        scratch.drop(held, pairs, least, large, near)
        held = after
        if same:
            break
        if left <= local:
            held, groups = _local(after, 1, scratch), 1
            scratch.drop(after)
    roots = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = scratch.table(roots.union(held.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")))
    scratch.drop(held)
    return found
