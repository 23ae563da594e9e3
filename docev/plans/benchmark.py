"""Benchmark samples of six kinds from projects, pairs and rules, in one numbering, with their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..operators import aggregate, judge

KINDS = ["extraction", "matching", "knowledge", "reasoning", "evaluation", "calculation"]
COUNTED = ["difficulty", "question_type", "task_domain", "industry_code"]


def _samples(frame: DataFrame, kind: str, difficulty: str, domain: Column, question: Column, project: Column, industry: Column, *order: Column) -> DataFrame:
    """Rows of one kind, ordered by columns of which the first is a number, if it is one, and then a text."""
    padded = [order[0].cast("string").try_cast("long"), *order, *[F.lit("")] * (3 - len(order))]
    places = [c.cast("string" if k else "long").alias(f"o{k}") for k, c in enumerate(padded)]
    told = [F.lit(kind).alias("question_type"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(difficulty).alias("difficulty"), domain.alias("task_domain"), question.alias("question"), project.cast("string").alias("source_project_id"), industry.alias("industry_code")]
    return frame.select(*told, *places)


def industries(projects: DataFrame, most: int) -> list[str]:
    """The first industries by code, at most ``most``; the sample one if there are none."""
    found = projects.select("industry_code").where("industry_code is not null and industry_code != ''").distinct().orderBy("industry_code").limit(most).collect()
    return [r.industry_code for r in found] or [config.SAMPLE_INDUSTRY]


def candidates(projects: DataFrame, pairs: DataFrame, rules: DataFrame, kinds: Sequence[str] = KINDS, task_domain: str | None = None) -> DataFrame:
    """Samples of the given kinds: sample_id, seq, question_type, difficulty, task_domain, source_project_id,
    industry_code, question, need_human_review. A project (project_id, industry_code) gives one a domain; a pair
    (project_id, industry_code, approval_title, report_name) one; the first ten industries one each; the first five with
    rules (industry_code, rule_id, check_point) one from their first five rules; scenarios three; and calculations three,
    of the first three projects. A task domain leaves extraction, for the domain if it has it, and matching. The numbering
    is by kind, then by project (as a number where its id is one), pair or industry; ids and texts that are missing are the sample ones or empty."""
    spark, c = projects.sparkSession, F.col
    industry = F.coalesce("industry_code", F.lit(config.SAMPLE_INDUSTRY))
    project = F.coalesce(c("project_id").cast("string"), F.lit(config.SAMPLE_PROJECT))
    fixed = (F.lit(config.SAMPLE_PROJECT), F.lit(config.SAMPLE_INDUSTRY))
    made: dict[str, DataFrame] = {}
    domains = [d for d in config.EXTRACTION_DOMAINS if task_domain in (None, d)]
    if "extraction" in kinds and domains:
        each = projects.select("project_id", "industry_code", F.posexplode(F.array(*map(F.lit, domains))).alias("at", "domain"))
        made["extraction"] = _samples(each, "extraction", "simple", c("domain"), F.format_string(config.EXTRACTION_QUESTION, "domain", project), project, industry, c("project_id"), industry, c("at"))
    if "matching" in kinds:
        head = lambda name: F.substring(F.coalesce(name, F.lit("")), 1, 80)
        made["matching"] = _samples(pairs, "matching", "medium", F.lit("报告-批复对应"), F.format_string(config.MATCHING_QUESTION, head("approval_title"), head("report_name")), project, industry, c("project_id"), c("approval_title"), c("report_name"))
    codes = industries(projects, 10)
    listed = spark.createDataFrame([(x,) for x in codes], "industry_code string")
    if "knowledge" in kinds and task_domain is None:
        made["knowledge"] = _samples(listed, "knowledge", "simple", F.lit("标准引用"), F.format_string(config.KNOWLEDGE_QUESTION, "industry_code"), fixed[0], c("industry_code"), F.lit(0), c("industry_code"))
    if "reasoning" in kinds and task_domain is None:
        place = F.row_number().over(Window.partitionBy("industry_code").orderBy("rule_id", "check_point"))
        first = rules.where(c("industry_code").isin(codes[:5])).select("industry_code", "check_point", "rule_id").withColumn("place", place).where("place <= 5")
        told = first.groupBy("industry_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("check_point", F.lit("")).alias("x")))), lambda s: s["x"]), "; ").alias("told"))
        made["reasoning"] = _samples(told, "reasoning", "hard", F.lit("行业经验归纳"), F.format_string(config.REASONING_QUESTION, "industry_code", F.substring("told", 1, 500)), fixed[0], c("industry_code"), F.lit(0), c("industry_code"))
    if "evaluation" in kinds and task_domain is None:
        scenes = spark.createDataFrame([(k, d, config.EVALUATION_QUESTION % s) for k, (d, s) in enumerate(config.EVALUATION_SCENARIOS)], "at int, domain string, question string")
        made["evaluation"] = _samples(scenes, "evaluation", "hard", c("domain"), c("question"), *fixed, c("at"))
    if "calculation" in kinds and task_domain is None:
        scenes = spark.createDataFrame([(k, d, q) for k, (d, q) in enumerate(config.CALCULATIONS)], "at int, domain string, question string")
        order = [c("project_id").cast("string").try_cast("long"), c("project_id"), industry]
        first = projects.select("project_id", "industry_code").orderBy(*order).limit(len(config.CALCULATIONS))  # three rows
        numbered = first.withColumn("at", F.row_number().over(Window.orderBy(*order)) - 1)
        made["calculation"] = _samples(scenes.join(numbered, "at", "left"), "calculation", "medium", c("domain"), c("question"), project, industry, c("at"))
    rows = None
    for kind in KINDS:
        if kind in made:
            rows = made[kind] if rows is None else rows.unionByName(made[kind])
    if rows is None:
        raise ValueError("no kind of sample is left")
    rows = aggregate.numbered(rows, "seq", "%d", c("kind"), *[c(f"o{k}") for k in range(4)]).withColumn("seq", c("seq").cast("long"))
    ident = F.format_string("SAMPLE_%s_%s_%03d", "industry_code", F.upper("question_type"), "seq")
    return rows.select(ident.alias("sample_id"), "seq", "question_type", "difficulty", "task_domain", "source_project_id", "industry_code", "question", F.lit(True).alias("need_human_review"))


def statistics(samples: DataFrame) -> DataFrame:
    """field, value and n: the samples by difficulty, kind, domain and industry, and all of them, in one pass."""
    told = samples.select(F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("value")) for name in COUNTED], F.struct(F.lit("total").alias("field"), F.lit("").alias("value")))).alias("s"))
    return told.groupBy("s.field", "s.value").agg(F.count("*").alias("n"))


def build(projects: DataFrame, pairs: DataFrame, rules: DataFrame, industry: str | None = None, difficulty: str | None = None, kind: str | None = None, task_domain: str | None = None, most: int | None = None) -> dict[str, DataFrame]:
    """samples and their statistics. An industry restricts projects and pairs, a limit the pairs and then all samples, the
    first by number; a difficulty is applied to numbered samples, so that numbers keep their gaps."""
    if industry is not None:
        projects, pairs = (x.where(F.col("industry_code") == industry) for x in (projects, pairs))
    if most is not None:
        pairs = pairs.orderBy("project_id", "approval_title", "report_name").limit(most)
    samples = candidates(projects, pairs, rules, KINDS if kind is None else [kind], task_domain)
    samples = judge.selected(samples, most, difficulty=difficulty)
    return {"samples": samples, "statistics": statistics(samples)}
