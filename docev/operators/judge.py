"""Judging of answers: a deterministic scorer, rubric bands, summaries, and benchmark candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import config
from ..functions import match
from . import aggregate

DIMENSIONS = tuple(config.JUDGE_DIMENSIONS)


def mocked(samples: DataFrame, table: Mapping[tuple[str, str], Sequence[int]] = config.JUDGE_SCORES, default: Sequence[int] = config.JUDGE_SCORES["L1_信息抽取", "medium"], dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Scores by (task_level, difficulty): overall and one a dimension, and what ``reviewed`` adds."""
    spark = samples.sparkSession
    names = ["overall_score", *dimensions]
    schema = "task_level string, difficulty string, " + ", ".join(f"{n} int" for n in names)
    scores = spark.createDataFrame([(a, b, *v) for (a, b), v in table.items()], schema)
    out = samples.join(F.broadcast(scores), ["task_level", "difficulty"], "left")
    for n, v in zip(names, default, strict=True):
        out = out.withColumn(n, F.coalesce(n, F.lit(v)))
    return reviewed(out)


def reviewed(scored: DataFrame) -> DataFrame:
    """Strengths, weaknesses, what lacks evidence, final_judgment, need_human_review and its priority."""
    c = F.col
    out = scored.withColumn("strengths", match.reasons([(c(d) >= n, told) for d, n, told in config.JUDGE_STRENGTHS]))
    out = out.withColumn("weaknesses", match.reasons([(c(d) < n, told) for d, n, told in config.JUDGE_WEAKNESSES]))
    out = out.withColumn("missing_evidence", c("evidence_grounding") < 85).withColumn("unsupported_claims", c("hallucination_control") < 85)
    out = out.withColumn("final_judgment", label(c("overall_score")))
    out = out.withColumn("need_human_review", (c("overall_score") < 50) | (c("hallucination_control") < 50) | (c("standard_accuracy") < 40))
    return out.withColumn("review_priority", F.when(c("overall_score") < 50, "高").when(c("overall_score") < 70, "中").otherwise("低"))


def evaluated(samples: DataFrame, answer: Callable[[list[str]], list[str | None]] | None, prompt: str, schema: str, fallback: DataFrame, key: str = "sample_id") -> DataFrame:
    """A scorer's JSON where it parses, else the fallback's row. ``answer`` takes a batch of prompts; a
    scorer behind a network belongs there, none is called here."""
    if answer is None:
        return fallback

    @F.pandas_udf(StringType())
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(answer(batch.tolist()), dtype="object")

    told = samples.select(key, F.from_json(asked(F.col(prompt)), schema).alias("r")).where("r.overall_score is not null")
    rest = fallback.join(told.select(key), key, "left_anti")
    return told.select(key, "r.*").unionByName(rest, allowMissingColumns=True)


def label(score: Column) -> Column:
    return match.banded(score, config.JUDGE_BANDS, config.JUDGE_LOWEST)


def summarised(results: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Means by dimension, and the histogram of labels."""
    return aggregate.dimension_means(results, dimensions), aggregate.counts(results, label(F.col("overall_score")), "label")


def weighted(accuracy: Column, evidence: Column, completeness: Column, expression: Column) -> Column:
    return accuracy * 0.35 + evidence * 0.30 + completeness * 0.20 + expression * 0.15


def candidates(kinds: Sequence[tuple[str, DataFrame, str]], pattern: str = "SAMPLE_%s_%s_%03d") -> DataFrame:
    """Benchmark candidates of several kinds in one numbering: kinds in order, each by its own key.
    Frames need industry_code, question and the key."""
    rows = None
    for k, (kind, frame, key) in enumerate(kinds):
        part = frame.select(F.lit(kind).alias("question_type"), F.lit(k).alias("type_order"), F.col(key).cast("string").alias("input_order"), F.coalesce("industry_code", F.lit("GEN")).alias("industry_code"), "question")
        rows = part if rows is None else rows.unionByName(part)
    number = F.row_number().over(Window.orderBy("type_order", "input_order"))
    return rows.withColumn("seq", number).withColumn("sample_id", F.format_string(pattern, "industry_code", F.upper("question_type"), "seq"))


def selected(rows: DataFrame, limit: int | None = None, **equal: str | None) -> DataFrame:
    """Equality filters that are given, then a limit in the rows' own order."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def effect(results: DataFrame, arm: str, hit: Column, expected: Column, cited: Column, good: Column) -> DataFrame:
    """Per arm: recall, false alarms and citation accuracy, as counts and unrounded ratios."""
    out = results.groupBy(arm).agg(F.count_if(hit & expected).alias("found"), F.count_if(expected).alias("expected"), F.count_if(hit & ~expected).alias("false_alarms"), F.count_if(hit).alias("hits"), F.count_if(cited & good).alias("good_citations"), F.count_if(cited).alias("citations"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumn("recall", ratio("found", "expected")).withColumn("false_alarm_rate", ratio("false_alarms", "hits")).withColumn("citation_accuracy", ratio("good_citations", "citations"))


def triggered(rows: DataFrame, gates: DataFrame, key: str = "metric") -> DataFrame:
    """Measures that lie outside a rule's gate, with its rule_id; gates have rule_id, metric, low and
    high (null: open)."""
    outside = F.coalesce(F.col("value") < F.col("low"), F.lit(False)) | F.coalesce(F.col("value") > F.col("high"), F.lit(False))
    return rows.join(gates, key).where(outside).drop("low", "high")
