"""Requirement mining: decisions to typed requirements with codes, substances and measures, their
summary and a quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, session
from ..functions import extract, match, spans, text
from ..operators import aggregate, segment


def validity(body: Column) -> Column:
    """struct(type, valid): a decision, or a text of another kind, by keyword counts and its start."""
    valid, core = match.hit_count(body, config.VALID_KEYWORDS), match.hit_count(body, config.CORE_KEYWORDS)
    report, public = match.hit_count(body, config.BODY_KEYWORDS), match.hit_count(body, config.PUBLIC_KEYWORDS)
    head = F.substring(body, 1, 5000)
    like = match.contains_any(head, ["建设项目环境影响报告表", "建设项目环境影响报告书"]) & match.contains_any(head, ["建设单位（盖章）", "中华人民共和国生态环境部制", "一、建设项目基本情况"])
    pick = lambda kind, ok: F.struct(F.lit(kind).alias("type"), F.lit(ok).alias("valid"))
    return (
        F.when((report >= 3) & ((report > valid) | (core < 2) | like), pick("wrong_type_report", False))
        .when((public >= 2) & ((public > valid) | (core < 2)), pick("wrong_type_public_participation", False))
        .when((valid >= 2) & (core >= 1), pick("valid_approval", True))
        .otherwise(pick("invalid_or_unknown", False))
    )


def doc_type(body: Column) -> Column:
    """struct(type, mode, conclusion) of a decision, the first step that holds."""
    head = F.substring(body, 1, 12000)
    has = lambda *terms: match.contains_any(head, terms)
    pick = lambda kind, mode, end: F.struct(F.lit(kind).alias("type"), F.lit(mode).alias("mode"), end.alias("conclusion"))
    unknown, agreed = F.lit("未知"), lambda *terms: F.when(has(*terms), "同意").otherwise("未知")
    refused = F.when(has("不予批准"), "不予批准").when(has("补正"), "需补正").otherwise("未知")
    return (
        F.when(has("不予批准", "退回", "补正", "不予许可"), pick("不予批准/退回/补正类", "未知", refused))
        .when(has("形式审查", "承诺事项", "撤销本次行政许可"), pick("报告表承诺制批复", "承诺制", agreed("同意")))
        .when(has("审批决定公告", "审批公告"), pick("审批决定公告", "未知", unknown))
        .when(has("报告书"), pick("报告书批复", "普通审批", agreed("可行", "同意")))
        .when(has("报告表") & has("经研究", "批复如下", "同意项目", "从生态环境保护角度可行"), pick("报告表普通批复", "普通审批", agreed("同意", "可行")))
        .otherwise(pick("未知批复", "未知", unknown))
    )


def inventory(bodies: DataFrame) -> DataFrame:
    """One row a text (path, body): its type, fields and validity."""
    rows = aggregate.numbered(bodies, "approval_id", "APPROVAL_%05d", F.col("path"))
    rows = rows.withColumn("body", text.clean_text(text.repaired(F.col("body"), config.VALID_KEYWORDS))).withColumn("v", validity(F.col("body"))).withColumn("t", doc_type(F.col("body")))
    shown = lambda field, other: F.when(F.col("v.valid"), F.col(f"t.{field}")).otherwise(other)
    body = F.col("body")
    tail = text.tail(body, 1000)
    return rows.select(
        "approval_id", F.col("path").alias("source_md"), shown("type", F.col("v.type")).alias("doc_type"), extract.title_by_pattern(body).alias("approval_title"),
        extract.doc_no(body).alias("approval_doc_no"), extract.date(tail, F.col("path")).alias("approval_date"), extract.first_match(F.substring(body, 1, 6000), config.AUTHORITY_PATTERNS).alias("approval_authority"),
        extract.company(body).alias("company"), extract.project_name(body).alias("project_name"), extract.report_type(F.substring(body, 1, 8000), "未知").alias("report_type_referenced"),
        shown("mode", F.lit("未知")).alias("approval_mode"), shown("conclusion", F.lit("未知")).alias("approval_conclusion"), F.length(body).alias("text_length"), F.col("v.valid").alias("valid_approval_text"), "body",
    )


def value_tier(kind: Column, clause: Column) -> Column:
    """struct(can_be_qa, level): by the requirement's kind; a low one needs 80 characters."""
    pick = lambda ok, level: F.struct(ok.alias("can_be_qa"), F.lit(level).alias("level"))
    return F.when(kind.isin(*config.HIGH_VALUE), pick(F.lit(True), "high")).when(kind.isin(*config.MEDIUM_VALUE), pick(F.lit(True), "medium")).otherwise(pick(F.length(clause) >= 80, "low"))


def requirements(found: DataFrame) -> DataFrame:
    """One row a clause of a valid decision."""
    rows = segment.exploded(found.where("valid_approval_text"), segment.clause_array(F.col("body")), "clause")
    clause = F.col("clause")
    rows = rows.withColumn("requirement_type", match.best_label(clause, config.REQUIREMENTS, "其他"))
    evidence = F.when(F.lit(False), clause)
    for kind, terms in config.REQUIREMENTS.items():
        evidence = evidence.when(F.col("requirement_type") == kind, spans.focus(clause, terms, 320, marks=" ，。；;"))
    rows = rows.withColumn("q", value_tier(F.col("requirement_type"), clause))
    return rows.select(
        "approval_id", "pos", "company", "project_name", "doc_type", "requirement_type", F.substring(clause, 1, 1200).alias("requirement_text"), text.joined(extract.codes(clause)).alias("standards"),
        text.joined(match.sorted_terms(clause, config.POLLUTANTS)).alias("pollutants"), text.joined(match.sorted_terms(clause, config.MEASURES)).alias("control_measures"),
        evidence.alias("evidence"), F.col("q.can_be_qa").alias("can_be_qa"), F.col("q.level").alias("qa_value_level"),
    )


def summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Per type: count, ratio to valid decisions, the most telling text, and what it suits."""
    valid = found.agg(F.greatest(F.count_if("valid_approval_text"), F.lit(1)).alias("valid"))
    has = lambda c: (F.col(c) != "").cast("int")
    rank = F.struct(has("standards"), has("pollutants"), has("control_measures"), F.least(F.length("requirement_text"), F.lit(500)), F.negative(F.crc32("approval_id")), -F.col("pos"))
    shown = F.struct(F.substring("evidence", 1, 260).alias("text"), F.coalesce(F.nullif("project_name", F.lit("")), "company").alias("project"))
    out = rows.groupBy("requirement_type").agg(F.count("*").alias("count"), F.max_by(shown, rank).alias("r"), F.bool_or("can_be_qa").alias("suitable_for_qa"))
    out = out.crossJoin(F.broadcast(valid)).withColumn("ratio", F.col("count") / F.col("valid"))
    return out.select("requirement_type", "count", "ratio", F.col("r.text").alias("representative_text"), F.col("r.project").alias("representative_project"), "suitable_for_qa", F.col("requirement_type").isin(*config.COMPARABLE).alias("suitable_for_report_comparison"))


def mentions(found: DataFrame) -> DataFrame:
    """approval_id, code, good: good codes once a text, others as often as they occur."""
    good, bad = extract.mentions(F.col("body"))
    tag = lambda xs, ok: F.transform(xs, lambda c: F.struct(c.alias("code"), F.lit(ok).alias("good")))
    return found.select("approval_id", F.explode(F.concat(tag(good, True), tag(bad, False))).alias("m")).select("approval_id", "m.*")


def passes(found: DataFrame, cited: DataFrame, summed: DataFrame) -> DataFrame:
    """One row: enough valid texts, few of a wrong type, few bad codes, all main types, and all of it."""
    kinds = found.agg(F.count_if("valid_approval_text").alias("valid"), F.count_if(F.col("doc_type").startswith("wrong_type")).alias("wrong"), F.count("*").alias("total"))
    codes = cited.agg(F.count_if(~F.col("good")).alias("bad"), F.count("*").alias("codes"))
    main = summed.where(F.col("requirement_type").isin(*config.MAIN_TYPES) & (F.col("representative_text") != "")).agg(F.count("*").alias("types"))
    row = kinds.crossJoin(codes).crossJoin(main)
    ok = (F.col("valid") >= 100) & (F.col("wrong") * 10 < F.greatest("total", F.lit(1))) & (F.col("bad") * 20 < F.greatest("codes", F.lit(1))) & (F.col("types") == len(config.MAIN_TYPES))
    return row.withColumn("passed", ok)


def run(bodies: DataFrame) -> dict[str, DataFrame]:
    """All stages, by name, each written before the next reads it."""
    keep = session.checkpointed
    found = keep(inventory(bodies))
    rows, cited = keep(requirements(found)), keep(mentions(found))
    summed = keep(summary(found, rows))
    return {"inventory": found, "requirements": rows, "mentions": cited, "summary": summed, "gate": keep(passes(found, cited, summed))}
