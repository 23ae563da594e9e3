"""Connected components by alternating large and small stars, in DataFrame joins.

Every round is a written table, and so are the minima before they are joined back: a join of two plain
exchanges is one that AQE can split where a star's centre has many rows. A round's tables, and the
shuffles behind them, are deleted once the next round stands. Minima are aggregated before the shuffle.
The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str, b: str, stage: common.Stage, name: str) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node of an edge between two
    different nodes; a table of the stage."""
    at = lambda step, k: f"{name}-{step}{k}"
    pairs = stage.table(at("pairs", 0), edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state, k = _state(pairs), 0
    while state[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.table(at("near", k), both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stage.table(at("large", k), both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = stage.table(at("far", k), large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stage.table(at("pairs", k + 1), small.union(least.select("u", F.col("m").alias("v"))).distinct())
        stage.drop(at("pairs", k), at("near", k), at("large", k), at("far", k))
        k += 1
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = stage.table(name, roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    stage.drop(at("pairs", k))
    return found


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
