"""Aggregations, tops and first-of-equals. All of them aggregate before the shuffle; lists are bounded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config, session
from ..functions import text


def counts(frame: DataFrame, key: Column | str, name: str = "k") -> DataFrame:
    """Counts by key, the most frequent first, then by key."""
    key = F.col(key) if isinstance(key, str) else key
    return frame.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def path_counts(frame: DataFrame, path: str, unknown: str = "unknown") -> DataFrame:
    return counts(frame, F.coalesce(F.col(path), F.lit(unknown)))


def top(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    return frame.orderBy(*order).limit(k)


def top_in(frame: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group by a total order, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("rank", rank).where(F.col("rank") <= k)


def first_of(frame: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group, by aggregation, so that a hot group is combined before the shuffle."""
    columns = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")


def witnessed(frame: DataFrame, row_id: str, keys: Sequence[str], values: str, witness: str, least: int = 2) -> DataFrame:
    """Rows with ``verified``: every (keys, value) of the row has enough different witnesses; rows
    without values hold vacuously. ``n_values`` tells them apart."""
    pairs = frame.select(row_id, *keys, witness, F.explode(values).alias("value"))
    valid = pairs.groupBy(*keys, "value").agg(F.count_distinct(witness).alias("w"))
    judged = pairs.join(valid, [*keys, "value"]).groupBy(row_id).agg(F.bool_and(F.col("w") >= least).alias("ok"))
    rows = frame.join(judged, row_id, "left").withColumn("verified", F.coalesce("ok", F.lit(True)))
    return rows.withColumn("n_values", F.size(values)).drop("ok")


def shares(frame: DataFrame, group: str, value: str, unit: str) -> DataFrame:
    """How often a value occurs in a group against the group's units: strong from 80, general from 60
    in a hundred, by whole-number arithmetic. A value may occur more than once a unit."""
    total = frame.groupBy(group).agg(F.count_distinct(unit).alias("units"))
    rows = frame.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n")).join(total, group)
    band = F.when(F.col("n") * 10 >= F.col("units") * 8, "strong").when(F.col("n") * 10 >= F.col("units") * 6, "general").otherwise("rare")
    return rows.withColumn("band", band)


def tally(frame: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Per group, the count of each value and of all."""
    return frame.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def union_list(x: Column, most: int = 12) -> Column:
    """Sorted distinct elements of a group's arrays, capped as the feature asks. Elements are combined
    a task at a time, so explode and use ``collect_set`` where arrays are long."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))), 1, most)


def first_list(frame: DataFrame, keys: Sequence[str], value: Column, n: int, *order: Column) -> DataFrame:
    """Per group its first n values in order: ranked before they are collected, so a list holds n."""
    rows = top_in(frame.withColumn("value", value), keys, n, *order)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda s: s["value"]).alias("values"))


def first_by_prefix(frame: DataFrame, keys: Sequence[str], value: str, *order: Column, prefix: int = 100, longer: int = 30, n: int = 5) -> DataFrame:
    """As ``first_list`` over values longer than ``longer``, one for each prefix."""
    rows = frame.where(F.length(value) > longer).withColumn("prefix", F.substring(value, 1, prefix))
    rows = top_in(rows, [*keys, "prefix"], 1, *order).drop("rank")
    return first_list(rows, keys, F.col(value), n, *order)


def pivot(frame: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each value as columns, and the total of all rows, also those of other values."""
    return tally(frame, [key], column, values)


def summary(frame: DataFrame, label: str, unit: str, units: int | Column, value: str, ranks: Sequence[Column], tie: Column) -> DataFrame:
    """Per label: count, ratio to a number of units (it may pass 1), and a representative: the greatest
    by ranks, the smallest tie of equals."""
    best = F.max_by(F.col(value), F.struct(*ranks, -tie))
    units = F.lit(units) if isinstance(units, int) else units
    return frame.groupBy(label).agg(F.count("*").alias("count"), F.count_distinct(unit).alias("units"), best.alias("representative")).withColumn("ratio", F.col("count") / units)


def gate(frame: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: each check over all rows, and whether all hold."""
    row = frame.agg(*[check.alias(name) for name, check in checks.items()])
    every = F.lit(True)
    for name in checks:
        every = every & F.coalesce(F.col(name), F.lit(False))
    return row.withColumn("passed", every)


def dimension_means(frame: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The mean of each dimension, missing values as 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("double"), F.lit(0.0)).alias("score")) for d in dimensions]))
    return frame.select(pairs.alias("p")).groupBy("p.dimension").agg(F.avg("p.score").alias("mean"), F.count("*").alias("n"))


def duplicates(frame: DataFrame, key: str, ident: str) -> DataFrame:
    """Keys of more than one row, with their ids joined in order."""
    found = frame.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(ident).cast("string"))), ";").alias("ids"))
    return found.where("n > 1")


def reconciled(one: DataFrame, other: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Two sets of counts side by side: ok, error, or info where one is missing."""
    a, b = one.select(name, F.col(value).alias("left_value")), other.select(name, F.col(value).alias("right_value"))
    status = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), "info").when(F.col("left_value") == F.col("right_value"), "ok").otherwise("error")
    return a.join(b, name, "full").withColumn("status", status)


def error_tallies(rows: DataFrame, severity: Mapping[str, str] = config.ERROR_SEVERITY) -> DataFrame:
    """Errors of judged samples (sample_id, task_level, element, industry_code, error_types) by five axes in
    one pass: axis, value, n_errors and their share of all errors, n_samples that have one, and for axes of
    samples n_judged and the rate; ``systemic`` marks types that several samples show. A type counts once a
    row; null or empty error_types are a sample without errors; types without a severity are UNKNOWN."""
    axes = ["error_type", "task_level", "element", "severity", "industry_code"]
    types = F.array_distinct(F.coalesce("error_types", F.array().cast("array<string>")))
    one = rows.select("sample_id", "task_level", "element", "industry_code", F.explode_outer(types).alias("error_type"))
    one = one.withColumn("severity", F.when(F.col("error_type").isNotNull(), text.looked_up(F.col("error_type"), dict(severity), "UNKNOWN")))
    erring = F.when(F.col("error_type").isNotNull(), F.col("sample_id"))
    sums = one.groupingSets([[a] for a in axes], *axes).agg(F.grouping_id().alias("g"), F.count("error_type").alias("n_errors"), F.count_distinct(erring).alias("n_samples"), F.count_distinct("sample_id").alias("n_judged"))
    which = {a: (1 << len(axes)) - 1 - (1 << (len(axes) - 1 - k)) for k, a in enumerate(axes)}
    axis, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in axes:
        axis, value = F.when(F.col("g") == which[a], a).otherwise(axis), F.when(F.col("g") == which[a], F.col(a)).otherwise(value)
    out = sums.select(axis.alias("axis"), value.alias("value"), "n_errors", "n_samples", "n_judged").where("axis not in ('error_type', 'severity') or value is not null")
    sampled = ~F.col("axis").isin("error_type", "severity")
    every = F.sum("n_errors").over(Window.partitionBy("axis"))
    return out.select(
        "axis", "value", "n_errors", F.when(every > 0, F.col("n_errors") / every).alias("share"), "n_samples", F.when(sampled, F.col("n_judged")).alias("n_judged"), F.when(sampled, F.col("n_samples") / F.col("n_judged")).alias("rate"),
        ((F.col("axis") == "error_type") & (F.col("n_samples") > 1)).alias("systemic"),
    )


def distributions(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Independent counts by each column in one pass: dimension, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return frame.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def numbered(frame: DataFrame, name: str, pattern: str, *order: Column) -> DataFrame:
    """Ids such as F000001 in a total order without a global window: rows are sorted into ranges and
    written; each takes its place in its range plus the sizes of the ranges before it."""
    placed = session.checkpointed(frame.orderBy(*order))
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = placed.withColumn("__part", part).withColumn("__place", place)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__part", before.alias("__base"))
    number = F.format_string(pattern, F.col("__place") + F.col("__base") + 1)
    return rows.join(F.broadcast(bases), "__part").withColumn(name, number).drop("__part", "__place", "__base")


def running_until(frame: DataFrame, keys: Sequence[str], size: Column, order: Sequence[Column], cap: int, gap: int = 1) -> DataFrame:
    """Rows of each group until the joined size of those before reaches the cap; the first always."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    held = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.greatest(rank - 2, F.lit(0)) * gap
    return frame.withColumn("held", held).withColumn("rank", rank).where((F.col("held") < cap) | (F.col("rank") == 1))


def before(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, name: str) -> DataFrame:
    """The frame with the sum of ``size`` over the rows of its group that come before in a total order. Rows are dealt to
    ranges, summed within (group, range), and every range adds what the ranges before it hold of its first group: no
    group goes to one task, and no window lacks a key. One row a range, at most, is broadcast."""
    by = [*[F.col(k) for k in keys], *order]
    placed = frame.repartitionByRange(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("__range", F.spark_partition_id())
    placed = session.checkpointed(placed)
    sums = placed.groupBy(*keys, "__range").agg(F.sum(size).alias("__sum"))
    if keys:
        earlier = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        carries = sums.withColumn("__carry", earlier).where("__carry is not null")
    else:
        held, total = [], 0
        for r in sorted(sums.collect(), key=lambda r: r["__range"]):  # one row a range
            held.append((r["__range"], total))
            total += r["__sum"]
        carries = frame.sparkSession.createDataFrame(held, "__range int, __carry long")
    carries = carries.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"), "__carry")
    local = F.sum(size).over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = placed["__range"] == F.col("__at")
    for k in keys:
        same = same & placed[k].eqNullSafe(F.col(f"__{k}"))
    joined = placed.withColumn("__local", local).join(F.broadcast(carries), same, "left")
    return joined.withColumn(name, F.coalesce("__local", F.lit(0)) + F.coalesce("__carry", F.lit(0))).drop("__range", "__local", "__at", "__carry", *[f"__{k}" for k in keys])


def value_ranks(frame: DataFrame, value: str, keys: Sequence[str] = (), *sums: Column) -> DataFrame:
    """One row for each group and value: its count n, ``sums`` and the rank that its rows share, ties averaged.
    Values are counted before anything is ordered."""
    counted = frame.groupBy(*keys, value).agg(F.count("*").alias("n"), *sums)
    return before(counted, keys, [F.col(value)], "n", "__before").withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2).drop("__before")


def average_ranks(frame: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows with their rank within their group, ties averaged: the values' ranks, joined back."""
    ranks = value_ranks(frame, value, keys).select(*[F.col(c).alias(f"__{c}") for c in (*keys, value)], F.col("rank").alias(name)).hint("merge")
    same = None
    for c in (*keys, value):
        one = frame[c].eqNullSafe(ranks[f"__{c}"])
        same = one if same is None else same & one
    return frame.join(ranks, same).drop(*[f"__{c}" for c in (*keys, value)])


def carried(value: Column, keys: Sequence[str], *order: Column) -> Column:
    """The last value that isn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def membership(frame: DataFrame, key: str, sets: Sequence[tuple[DataFrame, str]], otherwise: str) -> DataFrame:
    """``tier``: the first set that holds the key."""
    tier = None
    for k, (ids, label) in enumerate(sets):
        frame = frame.join(ids.select(F.col(key)).distinct().withColumn(f"__in{k}", F.lit(True)), key, "left")
        tier = F.when(F.col(f"__in{k}"), label) if tier is None else tier.when(F.col(f"__in{k}"), label)
    return frame.withColumn("tier", tier.otherwise(otherwise)).drop(*[f"__in{k}" for k in range(len(sets))])


def shared_characters(a: Column, b: Column) -> Column:
    """How many different characters two texts share."""
    return F.size(F.array_intersect(F.split(a, ""), F.split(b, "")))
