"""Assignments that a pass in order makes, by connected components.

A pass over pairs in order, each pair consuming ends, never carries anything from one connected component of the pairs to
another. So components are found first, and every one of at most ``MOST`` pairs goes through the pass as a whole, many
of them in a task. Of a larger component the pass takes its first pairs in order, about ``MOST`` of them, which no later
pair can change; pairs that have lost an end go, and what is left is split into components anew. A component of n
pairs takes at most 2 n / ``MOST`` such rounds, and far fewer if it falls apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from .components import components

MOST = 500_000
_SHARES = [2.0**-k for k in range(25)]


def in_order(pairs: DataFrame, left: str, right: str, order: Sequence[Column], payload: Sequence[Column], by_left: bool, run: Callable[[pa.Table], pa.Table], most: int = MOST) -> DataFrame:
    """The pairs that ``run`` chooses, with ``took``: whether they consume their right end, and their left end too unless the
    pass is by left rows. ``run`` gets whole chunks of pairs (place, l, r and the payload) in any order, and returns place
    and took of those it chooses. ``order`` is total; with ``by_left`` it begins with the left rows' order, and a left row's
    pairs stay together."""
    scratch = session.Scratch(pairs.sparkSession, "assign")
    sorted_ = session.checkpointed(pairs.orderBy(*order)).withColumn("__place", F.monotonically_increasing_id())  # ascends with the order
    payload = [c.alias(f"p{k}") for k, c in enumerate(payload)]
    ends = sorted_.select(F.col("__place").alias("place"), F.xxhash64(F.lit("l"), left).alias("u"), F.xxhash64(F.lit("r"), right).alias("v"), F.col(left).alias("l"), F.col(right).alias("r"), *payload)
    open_, chosen = scratch.table(ends), []
    while True:
        roots = components(open_, scratch=scratch)
        rooted = open_.join(roots.withColumnRenamed("node", "u"), "u")
        if by_left:
            rooted = rooted.join(open_.groupBy("u").agg(F.min("place").alias("unit")), "u")
        else:
            rooted = rooted.withColumn("unit", F.col("place"))
        rooted = scratch.table(rooted)
        scratch.drop(roots, open_)
        sizes = rooted.groupBy("root").agg(F.count("*").alias("n"), F.percentile_approx("unit", _SHARES, 10_000).alias("cuts"))
        step = F.least(F.lit(len(_SHARES) - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / most)).cast("int")))
        sizes = scratch.table(sizes.select("root", "n", F.get("cuts", step).alias("cut")))
        total, largest = sizes.agg(F.sum(F.least("n", F.lit(most))), F.max("n")).first()
        if total is None:
            break
        split = rooted.join(sizes, "root").withColumn("now", (F.col("n") <= most) | (F.col("unit") <= F.col("cut"))).drop("n", "cut")
        split = rooted.withColumn("now", F.lit(True)) if largest <= most else split
        bucket = F.pmod(F.xxhash64("root"), F.lit(max(1, -(-int(total) // most))))
        told = scratch.table(split.where("now").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "place long, took boolean"))
        chosen.append(told)
        if largest <= most:
            scratch.drop(rooted, sizes)
            break
        taken = rooted.join(told.where("took"), "place").select("u", "v")
        gone = split.where("now").select("u") if by_left else taken.select("u")
        rest = split.where("not now").drop("root", "unit", "now")
        open_ = scratch.table(rest.join(gone.distinct(), "u", "left_anti").join(taken.select("v").distinct(), "v", "left_anti").select(*open_.columns))
        scratch.drop(rooted, sizes)
    if not chosen:
        return pairs.withColumn("took", F.lit(True)).limit(0)
    every = chosen[0]
    for more in chosen[1:]:
        every = every.unionByName(more)
    return sorted_.join(every, sorted_["__place"] == every["place"]).drop("place", "__place")


def _greedy(table: pa.Table) -> pa.Table:
    """Pairs in order, each taken if both its ends are free."""
    table = table.sort_by("place")
    lefts, rights, out = set(), set(), []
    for place, a, b in zip(*(table.column(c).to_pylist() for c in ("place", "l", "r")), strict=True):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            out.append(place)
    return pa.table([pa.array(out, pa.int64()), pa.array([True] * len(out), pa.bool_())], names=["place", "took"])


def one_to_one(edges: DataFrame, left: str, right: str, order: Sequence[Column], most: int = MOST) -> DataFrame:
    """The edges that a greedy pass in a total order takes, each consuming both its ends. Null ends are ends like others."""
    return in_order(edges, left, right, order, [], False, _greedy, most).select(*edges.columns)


def _by_level(score: Callable):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A block's classes, by falling score of their pairs: each pair of classes takes the first free rows of both, in order."""
        side, told, n = (table.column(c).to_numpy() for c in ("side", "told", "n"))
        (mine, left), (theirs, right) = ((told[side == k], n[side == k].copy()) for k in (0, 1))
        first, second = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        scores = score(mine[:, None], theirs[None, :]).reshape(-1)
        order = np.argsort(-scores, kind="stable")
        out = [np.zeros((0, 6), np.int64)]
        for level in np.split(order, np.flatnonzero(np.diff(scores[order])) + 1) if len(order) else []:
            a, b = level // len(right), level % len(right)
            if len(np.unique(a)) < len(a) or len(np.unique(b)) < len(b):
                raise ValueError("pairs of a class have equal scores")
            took = np.minimum(left[a] - first[a], right[b] - second[b])
            a, b, took, at = a[took > 0], b[took > 0], took[took > 0], scores[level[took > 0]]
            out.append(np.stack([mine[a], theirs[b], first[a], second[b], took, at], 1))
            first[a] += took
            second[b] += took
        rows = np.concatenate(out)
        block = pa.array([key[0].as_py()] * len(rows), table.schema.field("block").type)
        return pa.Table.from_arrays([block, *[pa.array(c) for c in rows.T]], names=["block", "l", "r", "from_l", "from_r", "n", "score"])

    return run


def one_to_one_by_class(left: DataFrame, right: DataFrame, block: str, ends: tuple[str, str], classes: tuple[str, str], score: Callable) -> DataFrame:
    """The pairs (both ends and ``score``, a long) that ``one_to_one`` takes of all pairs of each block by falling score, then left
    end, then right end, where ``score`` (a function of numpy arrays) depends on the rows' classes alone, and no class has the same
    score with two others. Among equal scores two classes then meet nothing but each other, and their free rows pair off in
    order: counts of rows by class decide who takes how many, and rows are looked up by their place in their class. Ends are
    whole, distinct and in one block; a task holds a block's classes, never its rows or pairs."""
    (one, two), (mine, theirs) = ends, classes
    # Groups' tasks are as many as blocks, and the pass holds classes times classes numbers.
    count = lambda frame, told, k: frame.groupBy(F.col(block).alias("block"), F.col(told).alias("told")).agg(F.count("*").alias("n")).withColumn("side", F.lit(k))
    counts = count(left, mine, 0).unionByName(count(right, theirs, 1))
    kind = left.schema[block].dataType.simpleString()
    took = counts.groupBy("block").applyInArrow(_by_level(score), f"block {kind}, l long, r long, from_l long, from_r long, n long, score long")
    took = took.select("block", "l", "r", "from_l", "from_r", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("__k"))
    placed = lambda frame, told, end, as_, k: frame.select(F.col(block).alias("block"), F.col(told).alias(as_), end, F.row_number().over(Window.partitionBy(block, told).orderBy(end)).cast("long").alias(k))
    took = took.withColumn("kl", F.col("from_l") + F.col("__k")).withColumn("kr", F.col("from_r") + F.col("__k"))
    found = took.join(placed(left, mine, one, "l", "kl"), ["block", "l", "kl"]).join(placed(right, theirs, two, "r", "kr"), ["block", "r", "kr"])
    return found.select(one, two, "score")


def _each_left(review: float):
    def run(table: pa.Table) -> pa.Table:
        """Left rows in order, each taking its best free right row; only clean pairs consume."""
        table = table.sort_by("place")
        used, out, at, best = set(), [], None, None

        def settle() -> None:
            if best is not None and (best[3] or best[0] >= review):
                out.append((best[2], best[3]))
                if best[3]:
                    used.add(best[4])

        for place, a, b, score, clean in zip(*(table.column(c).to_pylist() for c in ("place", "l", "r", "p0", "p1")), strict=True):
            if at is None or a != at[0]:
                settle()
                at, best = (a,), None
            if b not in used and (best is None or score > best[0]):  # the first of equals: places follow the right rows' order
                best = (score, None, place, clean, b)
        settle()
        return pa.table([pa.array([p for p, _ in out], pa.int64()), pa.array([t for _, t in out], pa.bool_())], names=["place", "took"])

    return run


def one_sided(edges: DataFrame, left: str, right: str, left_order: str, right_order: str, score: str, company: str,
              least: float = 30, clean: float = 90, review: float = 80, most: int = MOST) -> DataFrame:
    """Left rows in order each take the best right row still free among their edges (the first of equals by ``right_order``;
    keys of left rows and orders are one to one). A pair is clean from ``clean`` of the company's or the whole score, and
    consumes its right row; from ``review`` it is kept for review and leaves the right row free; below, the left row has
    none. A left row's own edges are in one task."""
    held = edges.where((F.col(company) >= least) & (F.col(score) > 0))
    is_clean = (F.col(company) >= clean) | (F.col(score) >= clean)
    order = [F.col(left_order), F.col(left), F.col(right_order), F.col(right)]
    found = in_order(held, left, right, order, [F.col(score).cast("double"), is_clean], True, _each_left(review), most)
    return found.withColumn("pair_status", F.when(F.col("took"), "clean").otherwise("needs_review")).select(*edges.columns, "pair_status")
