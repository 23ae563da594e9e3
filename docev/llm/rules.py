"""Operator 5 [native]: quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per text and stores measurements and one bit per failed rule.
``apply_policy`` decides by a versioned mask over those bits, and ``ablation`` counts, from the bits
alone, what each policy would keep with a rule taken out. Only DataFrame functions are used; windows
are compared inside a row by 64-bit hashes, so nothing is shuffled and no text is cut.

Defined results: a null text has no words and no lines; an empty or very short text fails
``too_few_words``; rows that repeat are judged each; an empty table gives no rows. Extra columns pass
through; names beginning with ``ql_`` are the operator's own, and such extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8


def _rules() -> dict[str, Column]:
    words = F.col("ql_words")
    return {
        "too_few_words": words < 20,
        "repeated_windows": F.col("ql_repeat_words") * 100 > words * 30,
        "symbol_heavy": F.col("ql_symbols") * 2 > words,
        "shouting": F.col("ql_exclaims") * 2 > words,
        "odd_word_length": (F.col("ql_word_chars") < words * 2) | (F.col("ql_word_chars") > words * 30),
        "repeated_lines": F.col("ql_dup_lines") * 2 > F.col("ql_lines"),
    }


#: Rule names in the order of their bits.
RULES = tuple(["too_few_words", "repeated_windows", "symbol_heavy", "shouting", "odd_word_length", "repeated_lines"])
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "shouting"),
    "v2": RULES,
}
PRODUCTION = "v2"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ql_words, ql_word_chars, ql_symbols, ql_exclaims, ql_lines, ql_dup_lines and
    ql_repeat_words (longs)."""
    docs = common.without(docs, "ql_")
    kept = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(common.WORD)
    rows = docs.select(
        *kept,
        F.regexp_extract_all(body, F.lit(common.WORD), F.lit(0)).alias("ql_w"),
        F.filter(F.split(body, "\n"), has_word).alias("ql_l"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("ql_symbols"),
        F.regexp_count(body, F.lit("!")).cast("long").alias("ql_exclaims"),
    )
    rows = rows.select(
        *kept, "ql_symbols", "ql_exclaims",
        F.size("ql_w").cast("long").alias("ql_words"),
        F.length(F.array_join("ql_w", "")).cast("long").alias("ql_word_chars"),
        F.size("ql_l").cast("long").alias("ql_lines"),
        (F.size("ql_l") - F.size(F.array_distinct("ql_l"))).cast("long").alias("ql_dup_lines"),
        F.transform("ql_w", lambda w: F.xxhash64(w)).alias("ql_h"),
    )
    measures = ["ql_words", "ql_word_chars", "ql_symbols", "ql_exclaims", "ql_lines", "ql_dup_lines"]
    starts = F.when(F.size("ql_h") >= WINDOW, F.sequence(F.lit(0), F.size("ql_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(*[F.get(F.col("ql_h"), i + k) for k in range(WINDOW)])
    rows = rows.select(*kept, *measures, F.transform(starts, window).alias("ql_v"))
    # Texts in which no window comes twice, nearly all, stop at the set of their hashes.
    twice = F.size(F.array_distinct("ql_v")) < F.size("ql_v")
    sorted_windows = F.sort_array(F.transform("ql_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*kept, *measures, F.when(twice, sorted_windows).alias("ql_s"))
    equal = lambda e, j: e["h"].eqNullSafe(F.get(F.col("ql_s"), j - 1)["h"]) | e["h"].eqNullSafe(F.get(F.col("ql_s"), j + 1)["h"])
    repeated = F.sort_array(F.transform(F.filter("ql_s", equal), lambda e: e["i"]))
    rows = rows.select(*kept, *measures, repeated.alias("ql_p"))
    new_words = F.transform("ql_p", lambda i, j: F.least(F.lit(WINDOW), i - F.coalesce(F.get(F.col("ql_p"), j - 1), F.lit(-WINDOW))))
    covered = F.aggregate(new_words, F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.select(*kept, *measures, F.coalesce(covered, F.lit(0)).cast("long").alias("ql_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ql_failed, a long with the bit of every failed rule."""
    bits = [F.when(test, F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in _rules().items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    # A filter on the bits must stay above the measures: pushed below them, it would hold each of their
    # expressions as often as it is used. An expression of the partition's number isn't pushed through.
    stay = F.spark_partition_id() * 0
    return measure(docs, text).withColumn("ql_failed", failed.bitwiseOR(stay).cast("long"))


def apply_policy(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """ql_kept: none of the policy's rules failed."""
    return entries.withColumn("ql_kept", F.col("ql_failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(entries: DataFrame) -> DataFrame:
    """policy, rule, n_docs, n_kept and n_kept_without: one aggregation over the bits of all rows."""
    patterns = entries.groupBy("ql_failed").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).alias("m"), F.lit(mask(p) & ~BIT[r]).alias("m_without")) for p, names in POLICIES.items() for r in names]
    cases = patterns.select("ql_failed", "n", F.explode(F.array(*rows)).alias("c"))
    passes = lambda m: F.sum(F.when(F.col("ql_failed").bitwiseAND(F.col(m)) == 0, F.col("n")).otherwise(0))
    return cases.groupBy("c.policy", "c.rule").agg(F.sum("n").alias("n_docs"), passes("c.m").alias("n_kept"), passes("c.m_without").alias("n_kept_without"))
