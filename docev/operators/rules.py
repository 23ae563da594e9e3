"""Rule induction from audited rows, and its export as a graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import extract, text
from . import aggregate

KEYS = ("industry_code", "element", "project_type")


def induced(rows: DataFrame, keys: Sequence[str] = KEYS, strong: int = 3, common: int = 2, pattern: str = "STRICT_RULE_%04d") -> DataFrame:
    """One rule a group: level by different pairs (A from 3, B from 2, else C), confidence a third a
    pair, and its standards, first answers and first ids in order. Rows need pair_id, qa_id, answer
    and codes."""
    base = rows.groupBy(*keys).agg(F.count_distinct("pair_id").alias("support_count"), F.count("*").alias("n_rows"))
    codes = aggregate.first_list(rows.select(*keys, F.explode("codes").alias("code")).distinct(), keys, F.col("code"), 12, F.col("code")).withColumnRenamed("values", "common_standards")
    answers = aggregate.first_list(rows, keys, F.substring("answer", 1, 260), 5, F.col("qa_id")).withColumnRenamed("values", "common_requirements")
    pairs = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("pair_id")).alias("source_pair_ids"))
    ids = aggregate.first_list(rows, keys, F.col("qa_id"), 20, F.col("qa_id")).withColumnRenamed("values", "source_qa_ids")
    out = base
    for part in (codes, answers, ids, pairs):
        out = out.join(part, list(keys), "left")
    n = F.col("support_count")
    out = out.withColumn("evidence_level", level(n, strong, common))
    out = out.withColumn("confidence", F.when(F.col("evidence_level") == "A", F.least(F.lit(1.0), n / 3)).otherwise(F.least(F.lit(0.7), n / 3)))
    element, a, none = F.col("element"), F.col("evidence_level") == "A", F.array().cast("array<string>")
    told = lambda *xs: F.array(*[F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]) for x in xs])
    out = out.withColumn("rule_status", text.looked_up(F.col("evidence_level"), {"A": "verified", "B": "candidate", "C": "observation"}))
    out = out.withColumn("trigger_condition", told(("项目属于 ", F.col("industry_code"), " 行业"), ("项目涉及", element, "审查事项")))
    out = out.withColumn("review_checkpoints", told(("是否识别并说明", element, "相关污染源或管理要求"), ("是否引用与该要素对应的有效标准",), ("报告内容是否能支撑批复中的审批要求",)))
    out = out.withColumn("expected_report_content", told((element, "来源或管理对象"), ("治理/处置/管理措施",), ("执行标准",), ("排放去向或管理要求",)))
    out = out.withColumn("limitations", F.when(a, none).otherwise(told(("样本数不足，需人工复核后再作为稳定规则使用",)))).withColumn("need_human_review", ~a)
    return out.withColumn("rule_id", text.numbered(pattern, [F.col(k) for k in keys]))


def level(n: Column, strong: int = 3, common: int = 2) -> Column:
    return F.when(n >= strong, "A").when(n >= common, "B").otherwise("C")


def graded(rows: DataFrame, keys: Sequence[str], a: int = 3, b: int = 2) -> DataFrame:
    """Levels from the rows' own levels: A from enough A rows, B from enough B rows, else C; status by
    projects and their trusted share."""
    out = rows.groupBy(*keys).agg(F.count_if(F.col("level") == "A").alias("n_a"), F.count_if(F.col("level") == "B").alias("n_b"), F.count_if(F.col("level") == "C").alias("n_c"), F.count("*").alias("total"), F.count_distinct("project_id").alias("projects"))
    out = out.withColumn("rule_level", F.when(F.col("n_a") >= a, "A").when(F.col("n_b") >= b, "B").otherwise("C"))
    trusted = (F.col("n_a") + F.col("n_b")) * 10 >= F.col("total") * 6
    return out.withColumn("status", F.when((F.col("projects") >= 5) & trusted, "strong").when(F.col("projects") >= 3, "common").when(F.col("projects") >= 2, "candidate").otherwise("single"))


def merged(candidates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidate rules of one row each (project_id, standard, requirement, trigger, checkpoints, qa_id),
    merged by the three keys: different projects, standards and requirements; the first row's trigger
    and checkpoints."""
    first = lambda x: F.min_by(x, "qa_id").alias(x)
    out = candidates.groupBy(*keys).agg(
        F.count_distinct("project_id").alias("support_count"), F.array_sort(F.collect_set("standard")).alias("common_standards"),
        F.array_sort(F.collect_set("requirement")).alias("common_approval_requirement"), first("trigger"), first("checkpoints"),
    )
    n = F.col("support_count")
    code = F.when(F.coalesce("industry_code", F.lit("")) == "", "X").otherwise(F.col("industry_code"))
    out = out.withColumn("rule_id", F.format_string("RULE_%s_%s_%s_AGG", code, F.upper("element"), F.col("project_type")))
    out = out.withColumn("rule_status", F.when(n >= 5, "strong").when(n >= 3, "common").otherwise("candidate")).withColumn("confidence", F.least(F.lit(1.0), n / 5))
    return out.withColumn("limitations", F.when(n < 5, F.array(F.lit("样本有限，需更多项目验证"))).otherwise(F.array().cast("array<string>")))


def experience(rules: DataFrame, industries: Sequence[str] | None = None, features: Mapping[str, Sequence[str]] = config.EXPERIENCE_FEATURES, written: DataFrame | None = None) -> DataFrame:
    """Rules as experience pairs with a ladder of automation, the element's features and the kinds of
    source that a level rests on; then the pairs ``written`` by hand, which may lack columns."""
    rows = rules if industries is None else rules.where(F.col("industry_code").isin(*industries))
    ladder = F.when((F.col("evidence_level") == "A") & (F.col("confidence") >= 0.8), "auto_rule").when(F.col("evidence_level").isin("A", "B"), "strong_hint").otherwise("human_attention")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs])
    own = F.when(F.lit(False), texts(["x"]))
    for element, terms in features.items():
        own = own.when(F.col("element") == element, texts(terms))
    kinds = F.when(F.col("evidence_level") == "A", texts(config.EVIDENCE_SOURCES["A"])).when(F.col("evidence_level") == "B", texts(config.EVIDENCE_SOURCES["B"])).otherwise(texts(config.EVIDENCE_SOURCES["C"]))
    own = F.array_sort(F.array_distinct(F.concat(F.array("industry_code"), F.coalesce(own, F.array().cast("array<string>")))))
    out = rows.withColumn("automation_level", ladder).withColumn("experience_id", F.concat(F.lit("EXP_"), "rule_id")).withColumn("project_features", own).withColumn("evidence_source_type", kinds)
    return out if written is None else out.unionByName(written, allowMissingColumns=True)


def _by_element(table: Mapping[str, Sequence[str]], otherwise: Sequence[str]) -> Column:
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    found = F.when(F.lit(False), texts(otherwise))
    for name, xs in table.items():
        found = found.when(F.col("element") == name, texts(xs))
    return found.otherwise(texts(otherwise))


def library(rows: DataFrame, order: str, version: int = 2) -> DataFrame:
    """The library of rules by industry, element and project type (null: "?"), of rows with level (A, B or
    C), project_id, answer and standards; of equal levels in ``order``, whose values are unique. Version 2
    cleans the standards and keeps those that fit the element, wants three B rows for a B rule, and rests
    confidence on projects; version 1 takes standards as they are and adds pollutants, measures and the
    unrounded support ratio. Lists hold the first 5 answers of different beginnings, 10 standards and rows
    and 20 projects, the sets sorted; a null or empty project counts for none."""
    keys, none, new = list(KEYS), F.array().cast("array<string>"), version == 2
    rows = rows.withColumns({k: F.coalesce(F.col(k), F.lit("?")) for k in keys}).withColumn("project", F.when(F.col("project_id") != "", F.col("project_id")))
    at = (F.col("level"), F.col(order))
    codes = F.filter(F.coalesce("standards", none), lambda c: c != "")
    if new:
        codes = extract.fitting_codes(F.col("element"), F.filter(F.transform(codes, extract.library_code), extract.library_valid))
    told = rows.withColumn("answer", F.coalesce("answer", F.lit("")))
    answers = aggregate.first_by_prefix(told, keys, "answer", *at, prefix=100 if new else 120, longer=30 if new else 20, n=5)
    lists = {
        "common_approval_requirement": answers.withColumn("values", F.transform("values", lambda x: F.substring(x, 1, 200 if new else 120))),
        "common_standards": aggregate.first_list(rows.select(*keys, F.explode(codes).alias("x")).distinct(), keys, F.col("x"), 10, F.col("x")),
        "source_project_ids": aggregate.first_list(rows.where("project is not null").select(*keys, "project").distinct(), keys, F.col("project"), 20, F.col("project")),
        "source_qa_ids": aggregate.first_list(rows, keys, F.concat(F.coalesce("project_id", F.lit("")), F.lit("_"), "element"), 10, *at),
    }
    n_of = lambda level: F.count_if(F.col("level") == level).alias(level)
    out = rows.groupBy(*keys).agg(F.struct(n_of("A"), n_of("B"), n_of("C"), F.count("*").alias("total")).alias("sample_counts"), F.count_distinct("project").alias("support_count"))
    for name, found in lists.items():
        out = out.join(found.withColumnRenamed("values", name), keys, "left").withColumn(name, F.coalesce(name, none))
    a, b, c, total, n, element = (F.col(x) for x in ("sample_counts.A", "sample_counts.B", "sample_counts.C", "sample_counts.total", "support_count", "element"))
    out = out.withColumn("evidence_level", F.when(a >= 3, "A").when(b >= (3 if new else 2), "B").otherwise("C"))
    is_a, is_c = F.col("evidence_level") == "A", F.col("evidence_level") == "C"
    sure = F.when(is_a, F.least(F.lit(1.0), n / 5)).otherwise(F.least(F.lit(0.6), n / 5))
    if not new:
        sure = F.when(is_a, F.least(F.lit(1.0), a / 5)).when(~is_c, F.least(F.lit(0.7), b / 5)).when(total >= 2, 0.3).otherwise(0.1)
    few = F.format_string("样本数不足，仅%d个项目" + ("，不能作为行业稳定规律" if new else ""), n)
    limits = F.array(F.when(n < 3, few), F.when(is_c, "证据等级为C，未通过原文证据审计" if new else "证据等级为C级，未通过原文证据审计"), F.when(c > a + b, "低可信样本占比过高"))
    out = out.withColumns({
        "rule_id": F.concat(F.lit("RULE_"), "industry_code", F.lit("_"), F.upper(element), F.lit("_"), F.substring("project_type", 1, 2)), "rule_type": F.concat(element, F.lit("_review_rule" if new else "_review")),
        "rule_status": F.when((n >= 5) & ((a + b) * 10 >= total * 6), "strong_rule").when(n >= 3, "common_rule").when(n >= 2, "candidate_rule").otherwise("case_observation"), "confidence": sure,
        "trigger_condition": F.array_compact(F.array(F.concat(F.lit("项目属于 "), "industry_code", F.lit(" 行业")), text.looked_up(element, config.LIBRARY_TRIGGERS[version - 1]))),
        "review_checkpoints": _by_element(config.LIBRARY_CHECKPOINTS[version - 1], ["满足相关环保要求"]), "expected_report_content": _by_element(config.LIBRARY_CONTENT[version - 1], ["相关环保措施"]),
        "limitations": F.array_compact(limits), "need_human_review": is_c,
    })
    if new:
        return out
    return out.withColumns({"common_pollutants": _by_element(config.LIBRARY_POLLUTANTS, []), "common_control_measures": _by_element(config.LIBRARY_MEASURES, []), "support_ratio": n / total})


def behavior(rows: DataFrame) -> DataFrame:
    """Question rows (industry_code, element, standards, answer) with a behaviour rule: its trigger,
    checkpoints, expected content, the answer's start and the first standards."""
    element = F.col("element")
    general = F.concat(F.lit("项目属于"), text.default(F.col("industry_code"), "?"), F.lit("行业"))
    return rows.withColumn("behavior_rule", F.struct(
        F.coalesce(text.looked_up(element, config.BEHAVIOR_TRIGGERS), general).alias("trigger_condition"),
        _by_element(config.BEHAVIOR_CHECKPOINTS, ["是否满足相关环保要求"]).alias("review_checkpoints"), _by_element(config.BEHAVIOR_CONTENT, ["相关环保措施"]).alias("expected_report_content"),
        text.default(F.substring("answer", 1, 150)).alias("common_approval_requirement"), F.slice(F.coalesce("standards", F.array().cast("array<string>")), 1, 5).alias("common_standards"),
    ))


def gated(rules: DataFrame) -> DataFrame:
    """What a rule of each level may do: A asserts, B suggests, C flags for people."""
    return rules.withColumn("action", text.looked_up(F.col("evidence_level"), {"A": "assert", "B": "suggest"}, "flag"))


def triples(rules: DataFrame, standards: int = 5, most: int | None = None) -> DataFrame:
    """head, relation, tail, evidence (the rule's pairs) and source_type: industry to rule, rule to
    element, rule to its first standards."""
    rows = rules if most is None else rules.orderBy("rule_id").limit(most)
    rows = rows.withColumn("evidence", F.array_join(F.col("source_pair_ids").cast("array<string>"), ","))
    edge = lambda frame, head, relation, tail: frame.select(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), "evidence", F.lit("rule").alias("source_type"))
    cited = rows.select("rule_id", "evidence", F.explode(F.slice(F.coalesce("common_standards", F.array().cast("array<string>")), 1, standards)).alias("code"))
    return edge(rows, "industry_code", "HAS_STRICT_RULE", "rule_id").union(edge(rows, "rule_id", "CHECKS_ELEMENT", "element")).union(edge(cited, "rule_id", "USES_STANDARD", "code"))


def library_triples(rules: DataFrame, most: int = 100, valid: str = config.STANDARD_VALID) -> DataFrame:
    """head, relation, tail of the first rules: industry to rule, rule to element, to its first three
    projects and to the valid ones of its first three standards."""
    rows = rules.orderBy("rule_id").limit(most)
    edge = lambda frame, head, relation, tail: frame.select(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"))
    each = lambda array: rows.select("rule_id", F.explode(F.slice(array, 1, 3)).alias("t"))
    out = edge(rows, "industry_code", "HAS_RULE", "rule_id").union(edge(rows, "rule_id", "CHECKS", "element"))
    return out.union(edge(each("source_project_ids"), "rule_id", "SUPPORTED_BY", "t")).union(edge(each("common_standards").where(F.col("t").rlike(valid)), "rule_id", "USES_STANDARD", "t"))


def aggregated_triples(merged: DataFrame) -> DataFrame:
    """head, relation, tail, industry, evidence and source_type of merged rules: industry to element,
    element to its first three standards, and the first two checkpoints."""
    rows = merged.withColumn("industry", F.when(F.coalesce("industry_code", F.lit("")) == "", "?").otherwise(F.col("industry_code")))
    edge = lambda frame, head, relation, tail: frame.select(head.alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), "industry", F.lit("aggregated rule").alias("evidence"), F.lit("rule").alias("source_type"))
    each = lambda array, n: rows.select("industry", "element", F.explode(F.slice(array, 1, n)).alias("t"))
    out = edge(rows, F.col("industry"), "涉及要素", "element").union(edge(each("common_standards", 3), F.col("element"), "执行标准", "t"))
    return out.union(edge(each("checkpoints", 2), F.lit("审核检查点"), "针对要素", "t"))


def nodes(edges: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """label and id of every end, once; labels: relation to its ends' labels."""
    head = text.looked_up(F.col("relation"), {r: a for r, (a, _) in labels.items()})
    tail = text.looked_up(F.col("relation"), {r: b for r, (_, b) in labels.items()})
    return edges.select(head.alias("label"), F.col("head").alias("id")).union(edges.select(tail.alias("label"), F.col("tail").alias("id"))).distinct()


def missing_items(common: DataFrame, document: DataFrame, keys: Sequence[str], share: float = 0.6) -> DataFrame:
    """Items that enough cases of an industry have and a new document lacks."""
    return common.where(F.col("share") >= share).join(document.select(*keys).distinct(), list(keys), "left_anti")
