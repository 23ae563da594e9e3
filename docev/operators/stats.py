"""Paired statistics: seeded bootstrap intervals, t and Wilcoxon tests, effect sizes. All but the resampling and the
tail probabilities are native; the latter are functions of one aggregated row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

from .. import session
from ..functions import match
from . import aggregate


#: Different values of a group that one task resamples.
CELL = 100_000


def _resampled(resamples: int, seed: int):
    """The resample sums of one cell of a group: how many of the group's draws fall into each cell is drawn first, from the
    group's own generator, so that all cells agree on it; then the cell's share among its values."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        *group, cell = (k.as_py() for k in key)
        table = table.sort_by("v")
        values, counts = table.column("v").to_numpy(), table.column("c").to_numpy()
        sizes = np.array(table.column("sizes")[0].as_py(), np.int64)
        of = lambda *x: np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, group, *x)).encode(), digest_size=8).digest(), "little"))
        share = of("cells").multinomial(sizes.sum(), sizes / sizes.sum(), size=resamples)[:, cell]
        draw, chance, sums = of("values", cell), counts / counts.sum(), np.empty(resamples)
        step = max(1, 4_000_000 // len(values))
        for k in range(0, resamples, step):
            sums[k : k + step] = draw.multinomial(share[k : k + step], chance) @ values
        return pa.table([*[pa.array([g], table.schema.field(f"k{i}").type) for i, g in enumerate(group)], pa.array([cell], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=[*[f"k{i}" for i in range(len(group))], "cell", "sums"])

    return run


def bootstrap(frame: DataFrame, value: str, keys: Sequence[str] = (), resamples: int = 10_000, alpha: float = 0.05, seed: int = 42, cell: int = CELL) -> DataFrame:
    """Mean, standard error and percentile interval per group; null under three values. Equal values are counted first; a
    group's values are dealt by hash to cells of about ``cell`` of them, each cell adds one sum to every resample, and
    the sums of the cells are added: no row is copied and no task holds a group. Generators are seeded by the group and
    its cell, cells are added in order, and mean and error are rounded to nine digits, so reruns agree whatever the partitions."""
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    rows = frame.where(F.col(value).isNotNull()).select(*named, (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    counted = session.checkpointed(rows.groupBy(*ks, "v").agg(F.count("*").alias("c")))
    size = F.sum("c").cast("long")
    n_of = session.checkpointed(counted.groupBy(*ks).agg(size.alias("n"), (F.sum(F.col("v") * F.col("c")) / size).alias("mean"), F.ceil(F.count("*") / cell).cast("int").alias("cells")))
    spread = lambda side: None if not ks else reduce(lambda a, b: a & b, [counted[k].eqNullSafe(side[f"g{k}"]) for k in ks])
    groups = n_of.withColumnsRenamed({k: f"g{k}" for k in ks})
    joined = counted.join(groups.hint("merge"), spread(groups)) if ks else counted.crossJoin(F.broadcast(groups))  # without keys one row
    celled = joined.withColumn("cell", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int")).select(*ks, "v", "c", "n", "mean", "cells", "cell")
    squares = F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), 2))
    per_cell = celled.groupBy(*ks, "cell").agg(size.alias("m"), squares.alias("squares"), F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("cells").alias("cells"))
    listed = per_cell.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("cell", "m"))).alias("by_cell"), F.first("cells").alias("cells"), F.sum("squares").alias("squares"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    listed = session.checkpointed(listed.withColumn("sizes", F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda i: F.coalesce(F.try_element_at("by_cell", i), F.lit(0)))).drop("by_cell", "cells"))
    sized = listed.select(*[F.col(k).alias(f"g{k}") for k in ks], "sizes")
    with_sizes = celled.drop("n", "mean", "cells")
    same = reduce(lambda a, b: a & b, [with_sizes[k].eqNullSafe(sized[f"g{k}"]) for k in ks]) if ks else None
    with_sizes = (with_sizes.join(sized.hint("merge"), same) if ks else with_sizes.crossJoin(F.broadcast(sized))).select(*ks, "cell", "v", "c", "sizes")
    schema = T.StructType([*[T.StructField(k, with_sizes.schema[k].dataType) for k in ks], T.StructField("cell", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    sums = session.checkpointed(with_sizes.groupBy(*ks, "cell").applyInArrow(_resampled(resamples, seed), schema))
    by_draw = sums.select(*ks, "cell", F.posexplode("sums").alias("b", "s")).groupBy(*ks, "b").agg(F.array_sort(F.collect_list(F.struct("cell", "s"))).alias("parts"))
    totals = by_draw.select(*ks, F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"]).alias("total")).groupBy(*ks).agg(F.array_sort(F.collect_list("total")).alias("totals"))
    told = totals.withColumnsRenamed({k: f"g{k}" for k in ks})
    same = reduce(lambda a, b: a & b, [listed[k].eqNullSafe(told[f"g{k}"]) for k in ks]) if ks else None
    out = listed.join(told, same) if ks else listed.crossJoin(told)
    at = lambda p: F.when(F.col("n") >= 3, F.get("totals", F.lit(min(resamples - 1, int(p * resamples)))) / F.col("n"))
    error = F.sqrt(F.col("squares") / (F.col("n") - 1)) / F.sqrt("n")
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "n", F.round("mean", 9).alias("mean"), F.when(F.col("n") >= 3, F.round(error, 9)).alias("se"), at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            total *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * total


def t_two_sided(t: float, n: int) -> float:
    """The two-sided probability of Student's t with n - 1 degrees of freedom."""
    df = n - 1
    return _beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def _p_of_t(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else t_two_sided(x, int(k)) for x, k in zip(t, n, strict=True)], dtype="float64")


def paired(frame: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean_diff, sd_diff and t of the pairs' differences; zero spread has t 0."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = frame.where(d.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    return out.withColumn("t", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n"))).when(F.col("n") > 1, 0.0))


def t_test(frame: DataFrame, a: str, b: str, keys: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """``paired`` with p; ``compat`` gives 1, as the inverted tail that older results show clamps to."""
    out = paired(frame, a, b, keys)
    return out.withColumn("p", F.when(F.col("t").isNotNull(), F.lit(1.0)) if compat else _p_of_t("t", "n"))


#: Differences up to which the probability of a rank sum is exact.
EXACT = 100


def rank_sum_p(w: float, doubled: Sequence[int], times: Sequence[int]) -> float:
    """The two-sided probability of a smaller rank sum of at most ``w``: all signs of the ranks (given twice as large, each
    so many times) are alike, and their sums' distribution is built rank by rank."""
    ways = np.zeros(int(np.dot(doubled, times)) + 1)
    ways[0] = 1.0
    for rank, n in zip(doubled, times, strict=True):
        for _ in range(n):
            ways[rank:] = (ways[rank:] + ways[: len(ways) - rank]) / 2
            ways[:rank] /= 2
    return float(min(1.0, 2 * ways[: int(round(2 * w)) + 1].sum()))


def rank_sum_p_normal(w: float, n: int, ties: float) -> float:
    """As ``rank_sum_p`` by the normal distribution, with the variance that ties leave and a half's correction."""
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if variance <= 0 else min(1.0, math.erfc(max(0.0, n * (n + 1) / 4 - w - 0.5) / math.sqrt(2 * variance)))


def rank_sum_p_rough(w: float, n: int) -> float:
    """The rough approximation that older results show, clamped to 0.005."""
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return 1.0 if not spread else min(1.0, max(0.005, 2 / (1 + abs((w - n * (n + 1) / 4) / spread) ** 2.5)))


@F.pandas_udf(DoubleType())
def _p_of_w(w: pd.Series, n: pd.Series, ties: pd.Series, ranks: pd.Series) -> pd.Series:
    def one(w, n, ties, ranks):
        if w is None or w != w:
            return None
        if n == 0:
            return 1.0
        return rank_sum_p(w, [r["r"] for r in ranks], [r["n"] for r in ranks]) if n <= EXACT else rank_sum_p_normal(w, int(n), ties)

    return pd.Series([one(*row) for row in zip(w, n, ties, ranks, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _rough_p_of_w(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else rank_sum_p_rough(x, int(k)) for x, k in zip(w, n, strict=True)], dtype="float64")


def wilcoxon(frame: DataFrame, a: str, b: str, keys: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """n (differences that aren't zero), w_plus, w_minus, w (the smaller), p and median_diff (of all differences); w and p
    are null under five. Ties share their average rank. p is exact up to ``EXACT`` differences, by the normal
    distribution beyond; ``compat`` gives the rough one. Ranks are those of values: differences are counted by value,
    and only the counts are ordered."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    rows = frame.select(*keys, d.alias("d")).where("d is not null")
    middle = rows.groupBy(*keys).agg(F.percentile("d", F.lit(0.5)).alias("median_diff"), F.count_if(F.col("d") != 0).alias("n"))
    ranked = aggregate.value_ranks(rows.where("d != 0").withColumn("size", F.abs("d")), "size", keys, F.count_if(F.col("d") > 0).alias("plus"))
    ranked = ranked.withColumnRenamed("n", "times")
    held = F.collect_list(F.struct((F.col("rank") * 2).cast("int").alias("r"), F.col("times").cast("int").alias("n")))
    few = ranked.groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("times") - F.col("plus"))).alias("w_minus"),
        F.sum(F.pow(F.col("times").cast("double"), 3) - F.col("times")).alias("ties"), F.sum("times").alias("of"),
    )
    none = F.array().cast("array<struct<r:int,n:int>>")
    if keys:
        out = middle.join(few, list(keys), "left")
        small = ranked.join(few.where(F.col("of") <= EXACT).select(*keys), list(keys)).groupBy(*keys).agg(held.alias("ranks"))
        out = out.join(small, list(keys), "left")
    else:
        out = middle.crossJoin(few)  # one row each
        small = ranked.crossJoin(F.broadcast(few.where(F.col("of") <= EXACT).select("of"))).agg(held.alias("ranks"))
        out = out.crossJoin(small)
    w = F.when(F.col("n") >= 5, F.least("w_plus", "w_minus"))
    out = out.withColumn("w", w).withColumn("ranks", F.coalesce("ranks", none))
    p = _rough_p_of_w("w", "n") if compat else _p_of_w("w", "n", F.coalesce("ties", F.lit(0.0)), "ranks")
    return out.withColumn("p", p).drop("ties", "of", "ranks")


def cohens_d(frame: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """``paired`` with d, its size in words and its direction."""
    out = paired(frame, a, b, keys)
    d = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff")).otherwise(0.0)
    label = match.banded(F.abs("d"), [(0.8, "large"), (0.5, "medium"), (0.2, "small")], "negligible")
    direction = F.when(F.col("d") > 0, "a").when(F.col("d") < 0, "b").otherwise("none")
    return out.withColumn("d", d).withColumn("size", label).withColumn("direction", direction)


def sessions(frame: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Numbers each key's sessions: a new one begins after a gap."""
    order = Window.partitionBy(key).orderBy(ts)
    new = (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(order) > gap_seconds * 1_000_000).cast("int")
    return frame.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")


def severity(share: Column) -> Column:
    """Bands of a share: over half high, from three tenths medium, else low."""
    return F.when(share > 0.5, "high").when(share >= 0.3, "medium").otherwise("low")
