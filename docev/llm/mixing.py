"""Operator 1 [native]: mixing sources to target weights.

Sizes are summed per source; each source gets a target by weight, capped at ``cap`` times its size,
and a repetition rate of target / size. A document is emitted floor(rate) times, plus one copy drawn
from a hash of its id with probability equal to the fraction. Only DataFrame functions are used.

Defined results: a null text has size 0; sources are ordered by code point with null last and null is
a source of its own; a source of size 0 has target 0 and rate 0; rows that repeat a doc_id draw alike,
and each of them counts; a null doc_id draws as the empty string; an empty table gives no rows. Extra
columns pass through ``emit``; names beginning with ``mix_`` are the operator's own, and such extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: mix_source, mix_source_size, mix_target, mix_rate.

    Weights repeat over the sources in order. Capping and resharing until no target is above its cap
    has a closed form: ordered by cap / weight, the capped sources are a prefix, and all others get
    the level at which the rest of the total is used up. The windows run over one row per source.
    """
    by_source = sized.groupBy(F.col("mix_source")).agg(F.sum("mix_size").alias("mix_source_size"))
    order = W.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy()
    table = by_source.withColumn("w", weight).withColumn("cap", F.col("mix_source_size") * F.lit(float(cap)))
    table = table.withColumn("total", F.sum("mix_source_size").over(everything) * F.lit(float(share)))
    ordered = W.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    after = ordered.rowsBetween(W.currentRow, W.unboundedFollowing)
    table = table.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # Levels rise while the next source is capped and fall after: the highest is the one that holds.
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("w"))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    return table.withColumn("mix_target", target).select("mix_source", "mix_source_size", "mix_target", rate.alias("mix_rate"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed and the id; reruns agree."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED,
         doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target, mix_rate and mix_copies."""
    common.shared_dir(docs.sparkSession)
    docs = common.without(docs, "mix_")
    sized = docs.withColumn("mix_size", common.n_words(F.col(text)))
    table = targets(sized.select(F.col(source).alias("mix_source"), "mix_size"), weights, share, cap).checkpoint()
    joined = common.join_small(sized, table.withColumnRenamed("mix_source", source), source, table.count())
    rate = F.col("mix_rate")
    copies = F.floor(rate) + (draw(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("mix_copies", copies)


def emit(planned: DataFrame) -> DataFrame:
    """The mixture: each row as often as its plan says, without the plan's columns."""
    copies = planned.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.drop("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "mix_copy")
