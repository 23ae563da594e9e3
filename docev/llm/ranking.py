"""Operator 12: grouped ranking with ties, in two salted stages of windows.

Stage one prunes: rows are ranked within subgroups of (group, salt), and only those whose local place is
at most ``k`` go on. A local place is never above the global one, so nothing that belongs to the result is
lost, whatever the salts. Groups are salted where they are large: rows are counted in ``BINS`` bins of a
hash of the group, and a bin that holds more than one row in ``HOT`` of all gets as many salts as its
share asks for. At most ``HOT`` bins can do so, which bounds the one table that is broadcast.

Stage two ranks the survivors of all salts globally: they are dealt to ranges of (group, order), numbered
within (group, range), and every range adds its carry, the number of its first group's rows in the ranges
before it. Only a range's first group can have one, so there is at most one carry a range.

``tied`` counts all rows with a row's pair, pruned ones too: it sums partial counts that stage one takes in
each (group, salt) over the rows of a pair. Of a pair that can be in the result every subgroup's count
passes the pruning, since its rank there is at most its rank in all.

Defined results: null keys are groups of their own, null pairs are equal to each other; where nulls stand is
a part of the order. Rows that are equal in all columns count and are returned separately. An empty table
gives no rows. Extra columns are not read; names beginning with ``rk_`` are the operator's own. The rows
must come from a scan or a written table, whose order within a partition is the same when it is read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

BINS, HOT = 1 << 16, 1000
#: A column and how it is ordered: "asc" or "desc", nulls "first" or "last".
Order = tuple[str, str, str]


def _orders(columns: Sequence[Order]) -> list[Column]:
    return [getattr(F.col(c), f"{direction}_nulls_{nulls}")() for c, direction, nulls in columns]


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"rk_{c}"]) for c in columns])


def salted(rows: DataFrame, keys: Sequence[str], stage: common.Stage, bins: int = BINS, hot: int = HOT) -> DataFrame:
    """The rows with rk_salt: 0, or one of as many salts as a bin of ``keys`` has times a ``hot``-th of all rows."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(bins))
    counted = stage.table("bins", rows.groupBy(bucket.alias("rk_bin")).agg(F.count("*").alias("rk_n")))
    total = counted.agg(F.sum("rk_n")).first()[0] or 0
    large = counted.where(F.col("rk_n") * hot > total).select("rk_bin", F.ceil(F.col("rk_n") * hot / F.lit(max(total, 1))).alias("rk_salts"))
    joined = rows.withColumn("rk_bin", bucket).join(F.broadcast(large), "rk_bin", "left")  # at most ``hot`` rows
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("rk_salts"))
    return joined.withColumn("rk_salt", F.coalesce(salt, F.lit(0))).drop("rk_bin", "rk_salts")


def pruned(rows: DataFrame, keys: Sequence[str], pair: Sequence[Order], rest: Sequence[Order], k: int, place: str = "pos") -> DataFrame:
    """Of salted rows those whose local place is at most ``k``. The first of a pair in its subgroup carries the
    subgroup's count of that pair as rk_part. All windows share one exchange and one sort."""
    parts = [*keys, "rk_salt"]
    peers = W.partitionBy(*parts).orderBy(*_orders(pair))
    rows = rows.withColumn("rk_pos", F.row_number().over(W.partitionBy(*parts).orderBy(*_orders([*pair, *rest]))))
    rows = rows.withColumn("rk_rank", F.rank().over(peers)).withColumn("rk_ties", F.count("*").over(peers.rangeBetween(W.currentRow, W.currentRow)))
    kept = rows.where((F.col("rk_pos") if place == "pos" else F.col("rk_rank")) <= k)
    return kept.withColumn("rk_part", F.when(F.col("rk_pos") == F.col("rk_rank"), F.col("rk_ties"))).drop("rk_pos", "rk_rank", "rk_ties", "rk_salt")


def numbered(survivors: DataFrame, keys: Sequence[str], order: Sequence[Order], stage: common.Stage, ranges: int | None = None) -> DataFrame:
    """The rows with rk_pos, their number within their group in order, counted across ranges."""
    ranges = ranges or int(survivors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = survivors.withColumn("rk_draw", F.xxhash64(F.monotonically_increasing_id()))  # parts equal rows
    by = [*[F.col(c) for c in keys], *_orders(order), F.col("rk_draw")]
    placed = stage.table("placed", drawn.repartitionByRange(ranges, *by).withColumn("rk_range", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "rk_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("rk_range").rowsBetween(W.unboundedPreceding, -1))
    carries = sizes.select(*[F.col(c).alias(f"rk_{c}") for c in keys], F.col("rk_range").alias("rk_at"), before.alias("rk_before")).where("rk_before is not null")
    local = F.row_number().over(W.partitionBy(*keys, "rk_range").orderBy(*_orders(order), "rk_draw"))
    rows = placed.withColumn("rk_local", local)
    joined = rows.join(F.broadcast(carries), (rows["rk_range"] == carries["rk_at"]) & _same(rows, carries, keys), "left")  # one row a range at most
    return joined.withColumn("rk_pos", F.col("rk_local") + F.coalesce("rk_before", F.lit(0))).drop("rk_local", "rk_before", "rk_at", "rk_range", "rk_draw", *[f"rk_{c}" for c in keys])


def ranked(rows: DataFrame, keys: Sequence[str], pair: Sequence[Order], rest: Sequence[Order], k: int, stage: common.Stage,
           place: str = "pos", bins: int = BINS, hot: int = HOT, ranges: int | None = None) -> DataFrame:
    """The rows of each group of ``keys`` whose place is at most ``k``, with the keys, the columns of both orders,
    pos, place and tied. Rows are ordered by ``pair``, then by ``rest``; a row's place is its pos or, for
    ``place="rank"``, the pos of the first row with its pair."""
    pairs = [c for c, *_ in pair]
    rows = rows.select(*keys, *pairs, *[c for c, *_ in rest])
    survivors = stage.table("survivors", pruned(salted(rows, keys, stage, bins, hot), keys, pair, rest, k, place))
    numbers = numbered(survivors.drop("rk_part"), keys, [*pair, *rest], stage, ranges)
    renamed = [F.col(c).alias(f"rk_{c}") for c in (*keys, *pairs)]
    tied = survivors.where("rk_part is not null").groupBy(*renamed).agg(F.sum("rk_part").alias("rk_tied"))
    if place == "rank":
        numbers = stage.table("numbers", numbers)
        first = numbers.groupBy(*renamed).agg(F.min("rk_pos").alias("rk_place")).where(F.col("rk_place") <= k).hint("merge")
        numbers = numbers.join(first, _same(numbers, first, [*keys, *pairs])).drop(*[f"rk_{c}" for c in (*keys, *pairs)])
    else:
        numbers = numbers.where(F.col("rk_pos") <= k).withColumn("rk_place", F.col("rk_pos"))
    tied = tied.hint("merge")
    joined = numbers.join(tied, _same(numbers, tied, [*keys, *pairs]))
    return joined.select(*rows.columns, F.col("rk_pos").cast("long").alias("pos"), F.col("rk_place").cast("long").alias("place"), F.col("rk_tied").cast("long").alias("tied"))
