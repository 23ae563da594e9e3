"""Audits: ordered checks against source texts, tiers, scores and evidence chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import extract, match, text


def _by_element(element: Column, table: Mapping[str, Sequence[str]], make) -> Column:
    out = F.when(F.lit(False), make([]))
    for name, terms in table.items():
        out = out.when(element == name, make(terms))
    return out


def canonical_terms(element: Column, answer: Column, keywords: Mapping[str, Sequence[str]] = config.AUDIT_KEYWORDS, support: Mapping[str, Sequence[str]] = config.SUPPORT_TERMS) -> Column:
    """The answer's codes in scope, then the element's terms it holds; distinct, in order. The writer's
    and the auditor's dictionaries differ; pass either."""
    held = _by_element(element, {e: [*keywords[e], *support.get(e, [])] for e in keywords}, lambda terms: match.terms_in(answer, terms) if terms else F.array().cast("array<string>"))
    return F.array_distinct(F.concat(extract.element_codes(element, answer), F.coalesce(held, F.array().cast("array<string>"))))


def aligned(codes: Column, *texts: Column) -> Column:
    """There are codes, and each is in all texts."""
    every = lambda c: F.forall(F.array(*texts), lambda t: F.contains(t, c))
    return (F.size(codes) > 0) & F.forall(codes, every)


def overlap(element: Column, answer: Column, evidence: Column, support: Mapping[str, Sequence[str]] = config.SUPPORT_TERMS) -> Column:
    """The element's support terms in both texts."""
    return F.coalesce(_by_element(element, support, lambda terms: F.filter(match.terms_in(answer, terms), lambda t: F.contains(evidence, t)) if terms else F.array().cast("array<string>")), F.array().cast("array<string>"))


def found(needle: Column, hay: Column) -> Column:
    return F.coalesce((needle != "") & F.contains(hay, needle), F.lit(False))


def specific(element: Column, evidence: Column, keywords: Mapping[str, Sequence[str]] = config.AUDIT_KEYWORDS) -> Column:
    """Evidence with a keyword of its element and no excluded marker."""
    held = F.coalesce(_by_element(element, keywords, lambda terms: match.contains_any(evidence, terms)), F.lit(False))
    return held & ~match.contains_any(evidence, config.EXCLUDED_MARKERS)


def strict(rows: DataFrame) -> DataFrame:
    """Rows with issues, tier and score. Needs qa_id, pair_id, company, project_name, element, answer,
    task_domain, answer_terms, codes, approval_evidence, report_evidence (texts), blob, and the pair's
    report, approval (null without the pair) and meta_company."""
    c = F.col
    element, answer, approval, report = c("element"), c("answer"), c("approval"), c("report")
    flat_approval, flat_report = text.clean_text(approval), text.clean_text(report)
    body = F.btrim(F.replace(answer, F.lit("批复要求：")), F.lit("。"))
    known = lambda x: F.coalesce(x, F.lit(False))
    lacking = lambda x: known(~F.coalesce(_by_element(element, config.AUDIT_KEYWORDS, lambda terms: match.contains_any(x, terms)), F.lit(True)))
    supported = element.isin(*config.AUDIT_KEYWORDS)
    id_element = text.after_last(c("qa_id"))
    hazard = F.array(*[F.lit(t) for t in [*config.AUDIT_KEYWORDS["危废"], *config.SUPPORT_TERMS["危废"]]])
    forbidden = []
    for name, markers in config.FORBIDDEN_MARKERS.items():
        first = F.coalesce(*[F.when(match.has_marker(c("blob"), m), F.lit(f"{name}_qa_contains_forbidden_marker:{m}")) for m in markers])
        forbidden.append((known((element == name) & first.isNotNull()), first))
    water = F.concat_ws(" ", answer, c("approval_evidence"), c("report_evidence"), F.array_join("codes", " "))
    name = text.normalize(c("project_name"))
    prefixes = F.array(*[F.lit(p) for p in config.WATER_FORBIDDEN_PREFIXES])
    crossing = F.exists(extract.codes(water), lambda code: F.exists(prefixes, lambda p: F.startswith(code, p)))
    checks = [
        (known((text.default(c("meta_company")) != "") & (c("meta_company") != c("company"))), "metadata_company_mismatch"),
        (known((c("company") != "") & ~F.contains(approval, c("company"))), "company_in_approval_failed"),
        (known((c("company") != "") & ~F.contains(report, c("company"))), "company_in_report_failed"),
        (~match.name_in_both(name, text.normalize(report), text.normalize(approval)), "project_name_match_failed"),
        (~found(c("approval_evidence"), flat_approval), "approval_evidence_found_failed"),
        (~found(c("report_evidence"), flat_report), "report_evidence_found_failed"),
        (~found(F.substring(body, 1, 80), flat_approval), "answer_supported_by_approval_failed"),
        (~match.trimmed(answer), "answer_not_trimmed_to_element"),
        ((id_element == "") | (id_element != element), "qa_id_element_mismatch"),
        (c("task_domain") != element, "task_domain_element_mismatch"),
        (c("answer_terms") != canonical_terms(element, answer), "answer_terms_not_current_answer_element"),
        (c("codes") != extract.element_codes(element, answer), "standards_not_current_answer_element"),
        ((element == "噪声") & F.arrays_overlap("answer_terms", hazard), "noise_contains_hazard_terms"),
        ((element == "危废") & (c("task_domain") == "噪声"), "hazard_metadata_noise_mismatch"),
        *forbidden,
        ((element == "废水") & crossing, "water_qa_contains_cross_element_standard"),
        (~supported, "unsupported_element"),
        (lacking(answer), "answer_element_missing"),
        (lacking(c("approval_evidence")), "approval_element_missing"),
        (lacking(c("report_evidence")), "report_element_missing"),
        (supported & ~specific(element, c("report_evidence")), "report_evidence_not_specific_or_excluded"),
        ((F.size("codes") == 0) | ~F.forall("codes", lambda code: F.contains(answer, code)), "standards_missing_or_out_of_answer_scope"),
        (~aligned(c("codes"), answer, c("approval_evidence"), c("report_evidence")), "same_standard_alignment_failed"),
        (F.size(overlap(element, answer, c("report_evidence"))) == 0, "same_destination_or_measure_failed"),
    ]
    issues = F.when(approval.isNull() | report.isNull(), F.array(F.lit("pair_id_missing"))).otherwise(match.reasons(checks))
    return tiered(rows.withColumn("issues", issues), specific(element, c("report_evidence")))


def tiered(rows: DataFrame, good: Column, blockers: Sequence[str] = config.MEDIUM_BLOCKERS) -> DataFrame:
    """Tier and score by issues: high without any; medium without a blocker and with good evidence;
    else review."""
    n = F.size("issues")
    blocked = F.arrays_overlap("issues", F.array(*[F.lit(b) for b in blockers]))
    medium = ~blocked & good
    rows = rows.withColumn("tier", F.when(n == 0, "high").when(medium, "medium").otherwise("review"))
    missing = F.array_contains("issues", "pair_id_missing")
    return rows.withColumn("score", F.when(n == 0, 100).when(missing, 0).when(medium, F.greatest(F.lit(60), 100 - n * 8)).otherwise(F.greatest(F.lit(20), 100 - n * 10)))


def field_issues(rows: DataFrame) -> DataFrame:
    """One row for each field that differs from what its answer gives, and each term or marker that
    belongs to another element: qa_id, element, error_field, error_reason. ``blob`` is the row's
    searchable text."""
    c, element = F.col, F.col("element")
    issue = lambda name, *why: F.struct(F.lit(name).alias("error_field"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in why]).alias("error_reason"))
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    own = text.after_last(c("qa_id"))
    terms, codes = canonical_terms(element, c("answer")), extract.element_codes(element, c("answer"))
    checks = [
        F.when((own == "") | (own != element), issue("qa_id/element", "qa_id最后要素=", text.default(own, "空"), "，element=", element)),
        F.when(c("task_domain") != element, issue("benchmark_metadata.task_domain", "task_domain=", c("task_domain"), "，element=", element)),
        F.when(c("answer_terms") != terms, issue("answer_terms", "answer_terms 必须只来自当前 answer 和当前 element；actual=", listed(c("answer_terms")), "; expected=", listed(terms))),
        F.when(c("codes") != codes, issue("standards_normalized", "standards_normalized 必须只保留当前 QA 要素相关标准；actual=", listed(c("codes")), "; expected=", listed(codes))),
        *[F.when((element == "噪声") & F.array_contains("answer_terms", m), issue("answer_terms", f"噪声 QA answer_terms 不得出现 {m}")) for m in config.NOISE_FORBIDDEN_TERMS],
        *[F.when((element == e) & match.has_marker(c("blob"), m), issue("cross_element_marker", f"{e} QA 不得出现 {m}")) for e, markers in config.CROSS_MARKERS.items() for m in markers],
    ]
    return rows.select("qa_id", "element", F.explode(match.present(checks)).alias("i")).select("qa_id", "element", "i.*")


def sticky(rows: DataFrame, previous: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of a previous high tier, or of this one, that have field issues go to review, score 40 at
    most. The previous snapshot is an input, not a side effect."""
    old = previous.join(issues.select("qa_id").distinct(), "qa_id", "left_semi").select("qa_id")
    now = rows.where("tier = 'high'").join(issues.select("qa_id").distinct(), "qa_id", "left_semi").select("qa_id")
    forced = rows.join(old.union(now).distinct().withColumn("forced", F.lit(True)), "qa_id", "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    forced = forced.withColumn("issues", F.when(F.col("forced"), F.array_distinct(F.concat("issues", F.array(F.lit("field_consistency_failed"))))).otherwise(F.col("issues")))
    forced = forced.withColumn("score", F.when(F.col("forced"), F.least("score", F.lit(40))).otherwise(F.col("score")))
    return forced.withColumn("tier", F.when(F.col("forced"), "review").otherwise(F.col("tier")))


def deducted(penalties: Sequence[tuple[Column, int]], start: int = 100, zero: Column | None = None) -> Column:
    """100 less every penalty that applies, at least 0; 0 outright where ``zero`` holds."""
    score = F.lit(start)
    for check, points in penalties:
        score = score - F.when(check, points).otherwise(0)
    score = F.greatest(F.lit(0), score)
    return score if zero is None else F.when(zero, 0).otherwise(score)


def added(bonuses: Sequence[tuple[Column, int]], base: int = 0, most: int = 100) -> Column:
    score = F.lit(base)
    for check, points in bonuses:
        score = score + F.when(check, points).otherwise(0)
    return F.least(F.lit(most), score)


def graded(score: Column, conditions: Column, verified: int = 85, rejected: int = 60) -> Column:
    return F.when((score >= verified) & conditions, "verified").when(score < rejected, "rejected").otherwise("review")


def keyword_shares(terms: Sequence[str], *texts: Column) -> list[Column]:
    """The share of the terms that each text holds."""
    return [match.hit_count(t, terms) / len(terms) for t in texts]


def alignment(codes: Column, answer: Column, evidence: Column) -> tuple[Column, Column]:
    """Level and score of an answer's alignment with the texts of its evidence: 40 for its codes' first
    eight characters, 40 for its first five terms, 20 for a text of substance; unrounded."""
    flat, clean = F.array_join(evidence, " "), F.regexp_replace(answer, r"(?U)\s+", " ")
    terms = F.slice(F.regexp_extract_all(clean, F.lit(config.ALIGNMENT_TERM), F.lit(0)), 1, 5)
    share = lambda xs, n: F.size(F.filter(xs, lambda t: F.contains(flat, F.substring(t, 1, n)))) / F.greatest(F.size(xs), F.lit(1))
    substance = F.exists(evidence, lambda t: F.length(t) > F.least(F.lit(50), F.length(clean)))
    score = (share(codes, 8) * 0.4 + share(terms, 1 << 30) * 0.4 + F.when(substance, 0.2).otherwise(0.0)) * 100
    none = (F.coalesce(F.size(evidence), F.lit(0)) <= 0) | (text.default(answer) == "")
    level = F.when(none, "no_evidence").when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")
    return level, F.when(none, F.lit(0.0)).otherwise(score)


def keyword_alignment(terms: Sequence[str], answer: Column, report: Column, approval: Column) -> tuple[Column, Column]:
    """Level and score by the shares of an element's words that answer and evidence hold; unrounded."""
    a, e, p = keyword_shares(terms, answer, report, approval)
    high, medium = (a >= 0.3) & (e >= 0.2) & (p >= 0.2), (a >= 0.2) & (p >= 0.15)
    level = F.when(high, "high").when(medium, "medium").when(a >= 0.1, "low").otherwise("none")
    return level, F.when(high, (a + e + p) / 3 * 100).when(medium, (a + p) / 2 * 100).when(a >= 0.1, a * 100).otherwise(0.0)


def match_issues(company: Column, approval_file: Column, file_exists: Column) -> Column:
    """Issues of a row's link to its approval file."""
    name, file = F.substring(text.cjk_only(text.default(company)), 1, 4), text.default(approval_file)
    return match.reasons([
        ((file != "") & ~F.coalesce(file_exists, F.lit(False)), "approval_file_missing"), (file == "", "no_approval_file"),
        ((name != "") & (file != "") & ~F.contains(file, name), "company_approval_mismatch"),
    ])


def rescored(rows: DataFrame) -> DataFrame:
    """Score, issues and grade of rows with match_issues, n_approval and n_report (pieces of evidence),
    alignment_level, n_standards, task_domain, answer, question, original_question and
    question_rewritten."""
    c, known = F.col, lambda x: F.coalesce(x, F.lit(False))
    mismatch, none, low = F.size("match_issues") > 0, known(c("alignment_level") == "none"), known(c("alignment_level") == "low")
    short = F.length(text.cjk_only(text.default(c("answer")))) < 15
    asked = known(~c("question_rewritten")) & ~c("original_question").eqNullSafe(c("question"))
    unapproved, domain = c("n_approval") == 0, text.default(c("task_domain")) == ""
    found = match.reasons([
        (mismatch, "pair_mismatch"), (c("n_report") == 0, "no_report_evidence"), (none, "evidence_alignment_none"), (low, "evidence_alignment_low"), (c("n_standards") == 0, "no_standards"),
        (domain, "no_benchmark_metadata"), (short, "answer_too_short"), (asked, "question_element_mismatch"),
    ])
    score = deducted([(mismatch, 50), (c("n_report") == 0, 40), (none, 40), (low, 30), (c("n_standards") == 0, 20), (domain, 20), (short, 30), (asked, 30)], zero=unapproved)
    out = rows.withColumn("corrected_quality_issues", F.when(unapproved, F.array(F.lit("rejected_no_approval"))).otherwise(found)).withColumn("corrected_quality_score", score)
    good = (score >= 85) & ~mismatch & c("alignment_level").isin("high", "medium") & (c("n_standards") > 0)
    return out.withColumn("corrected_validation", F.when(known(good), "verified").when((score < 60) | unapproved, "rejected").otherwise("needs_human_review"))


def ten_points(rows: DataFrame) -> DataFrame:
    """Issue codes c1 to c10 and the codes that stay, of rows with company, approval_file,
    approval_source, question, original_question, answer, approval_texts, report_texts, codes,
    alignment_level, score and quality_issues."""
    c, some = F.col, lambda x: text.default(x)
    name = F.substring(text.cjk_only(some(c("company"))), 1, 6)
    file, source = some(c("approval_file")), some(c("approval_source"))
    in_file, in_source = (name != "") & F.contains(file, name), (name != "") & F.contains(source, name)
    start = lambda x: F.substring(text.cjk_only(x), 1, 6)
    asked = F.regexp_extract_all(F.coalesce(F.nullif(c("original_question"), F.lit("")), some(c("question"))), F.lit(config.QUESTION_COMPANY), F.lit(0))
    other = F.exists(asked, lambda x: (start(x) != name) & (F.length(start(x)) >= 4))
    flagged = F.exists("quality_issues", lambda x: F.contains(F.lower(x), F.lit("company")) | F.contains(F.lower(x), F.lit("mismatch")))
    answer, approval, report = some(c("answer")), F.array_join("approval_texts", " "), F.array_join("report_texts", " ")
    first = lambda p: F.slice(F.regexp_extract_all(answer, F.lit(p), F.lit(0)), 1, 3)
    terms, high = F.concat(first(config.ANSWER_CODE), first(config.ANSWER_TERM)), F.coalesce(c("alignment_level") == "high", F.lit(False))
    held = lambda x: F.exists(terms, lambda t: F.contains(x, t))
    sound = F.filter(F.transform("codes", lambda s: F.trim(s)), lambda s: (F.length(s) >= 5) & ~s.isin(*config.CHECK_GARBAGE))
    backed = lambda s: F.contains(answer, s) | F.contains(approval, F.substring(s, 1, 10)) | F.contains(report, F.substring(s, 1, 10))
    found = F.concat(match.reasons([
        (~(in_file | in_source), "c1_company_not_in_approval_source"), (in_file & in_source & (start(file) != "") & (start(source) != "") & (start(file) != start(source)), "c2_approval_source_mismatch"),
        (other, "c3_question_company_mismatch"), (flagged, "c4_company_mismatch_flagged"), (high & ~held(approval), "c5_high_ae_no_key_terms"), (high & ~held(report), "c5_high_ev_no_key_terms"),
        (extract.routes_differ(answer, report), "c6_discharge_mismatch"),
    ]), F.transform(F.filter(sound, lambda s: ~backed(s)), lambda s: F.concat(F.lit("c7_std_not_in_answer_"), F.substring(s, 1, 15))))
    found = F.when((c("score") == 100) & (F.size(found) > 0), F.concat(found, F.array(F.lit("c10_score_100_with_issues")))).otherwise(found)
    out = rows.withColumn("check_issues", found).withColumn("codes", F.filter(sound, backed))
    return out.withColumn("check_result", F.when(F.size("check_issues") > 0, "demoted").otherwise("verified"))


def chain(claims: DataFrame, rows: DataFrame, empty: Sequence[str] = config.EMPTY_ANSWERS) -> DataFrame:
    """Status, score and trace of rows by their claims' support (claims: qa_id, support in direct,
    indirect, unsupported, contradicted; rows: qa_id, answer, is_historical, has_report, has_approval).
    A claim that nothing supports leaves one source missing."""
    n = lambda kind: F.count_if(F.col("support") == kind)
    sums = claims.groupBy("qa_id").agg(F.count("*").alias("n_claims"), n("direct").alias("direct"), n("indirect").alias("indirect"), n("unsupported").alias("unsupported"), n("contradicted").alias("contradicted"))
    c = F.col
    out = rows.join(sums, "qa_id", "left").fillna(0, ["n_claims", "direct", "indirect", "unsupported", "contradicted"])
    answer = F.coalesce("answer", F.lit(""))
    placeholder = answer.isin(*empty) | F.contains(answer, F.lit("[PLACEHOLDER]")) | answer.rlike(r"(?U)^\s*\{")
    supported, total = c("direct") + c("indirect"), F.greatest(c("n_claims"), F.lit(1))
    status = (
        F.when(placeholder | (c("contradicted") > 0), "rejected").when(c("is_historical"), "reference_case").when(~c("has_report") | ~c("has_approval"), "need_human_review")
        .when(c("unsupported") > total * F.lit(0.3), "rejected").when(c("unsupported") > 0, "need_human_review").when(supported >= total * F.lit(0.8), "gold_verified").otherwise("need_human_review")
    )
    missing = (c("unsupported") > 0).cast("int")
    score = F.floor(c("direct") / total * 60) + F.floor(c("indirect") / total * 20)
    score = F.when(status == "rejected", F.least(score, F.lit(30))).when(status == "reference_case", F.least(score, F.lit(50))).when(status == "need_human_review", F.least(score, F.lit(75))).otherwise(F.greatest(score, F.lit(80)))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score - missing * 5))
    trace = F.when((c("unsupported") + c("contradicted") + missing) == 0, "complete").when(c("unsupported") <= c("n_claims") * F.lit(0.3), "partial").otherwise("failed")
    return out.withColumn("status", status).withColumn("evidence_score", score).withColumn("trace", trace)


def rule_review(rules: DataFrame) -> DataFrame:
    """Rules (support_count, common_standards, trigger_condition, review_checkpoints, n_a, element,
    expected_report_content, rule_status) with review_score, the mean of six sub-scores, review_issues,
    recommended_level and decision: keep, downgrade or invalid."""
    c, n, none = F.col, F.coalesce("support_count", F.lit(0)), F.array().cast("array<string>")
    texts = lambda name: F.coalesce(name, none)
    codes = F.filter(texts("common_standards"), lambda s: text.default(s) != "")
    garbage = F.filter(codes, lambda s: s.isin(*config.GARBAGE_CODES) | (F.length(s) < 4))
    valid = F.filter(codes, lambda s: s.rlike(r"(?U)^[A-Z]{1,3}[\d/-]+") & ~s.isin(*config.OUTLET_CODES) & (F.length(s) > 4))
    triggers, points, content = texts("trigger_condition"), texts("review_checkpoints"), texts("expected_report_content")
    vague_trigger = F.exists(triggers, lambda t: F.contains(t, F.lit("属于")) & (F.length(t) < 20)) & (F.size(triggers) <= 1)
    vague_points = (F.size(points) > 0) & F.forall(points, lambda p: F.contains(p, F.lit("是否")) & (F.length(p) < 15))
    wrong = (c("element") == "噪声") & F.exists(F.slice(valid, 1, 5), lambda s: match.contains_any(s, ["DB44", "GB31572", "GB16297"]))
    vague_content = (F.size(content) == 0) | ((F.size(content) == 1) & F.contains(F.get(content, F.lit(0)), F.lit("相关环保措施")))
    alone = (c("rule_status") == "case_observation") & (n < 3)
    checks = [
        (n < 2, 0, F.concat(F.lit("support_count_too_low_"), n.cast("string"))), (F.size(garbage) > 0, 30, F.concat(F.lit("garbage_standards_"), F.array_join(F.slice(garbage, 1, 3), ","))),
        (F.size(valid) == 0, 20, "no_valid_standards"), (vague_trigger, 20, "trigger_too_generic"), (F.size(points) == 0, 30, "no_checkpoints"), (vague_points, 15, "checkpoints_too_generic"),
        (F.coalesce("n_a", F.lit(0)) < 3, 30, F.concat(F.lit("insufficient_A_samples_"), F.coalesce("n_a", F.lit(0)).cast("string"))), (wrong, 20, "noise_rule_has_wrong_standards"),
        (vague_content, 20, "expected_content_too_generic"), (alone, 40, "case_observation_passed_as_A"),
    ]
    checks = [(F.coalesce(check, F.lit(False)), points_, code) for check, points_, code in checks]
    total = F.lit(250) + F.when(n >= 10, 100).when(n >= 5, 85).when(n >= 3, 70).when(n >= 2, 50).otherwise(20)
    for check, lost, _ in checks:
        total = total - F.when(check, lost).otherwise(0)
    score = total / 6
    level = F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("invalid")
    out = rules.withColumn("review_score", score).withColumn("review_issues", match.reasons([(check, code) for check, _, code in checks])).withColumn("recommended_level", level)
    return out.withColumn("decision", F.when(level == "A", "keep").when(level == "invalid", "invalid").otherwise("downgrade"))


def recheck_high(rows: DataFrame) -> DataFrame:
    """One row for each error of high rows: qa_id, pair_id, element, error_type, detail. Rows have
    task_domain, answer, answer_terms, codes, approval_evidence and report_evidence (arrays of texts),
    blob, and their pair's report and approval. Nulls count as empty; a row of an unknown element is
    checked for its id and domain only."""
    c, none = F.col, F.array().cast("array<string>")
    element, answer, terms_, codes_ = text.default(c("element")), text.default(c("answer")), F.coalesce("answer_terms", none), F.coalesce("codes", none)
    own, domain, blob = text.after_last(text.default(c("qa_id"))), text.default(c("task_domain")), text.default(c("blob"))
    known, flat = element.isin(*config.ELEMENT_KEYWORDS), text.compact(blob)
    issue = lambda kind, *why: F.struct(F.lit(kind).alias("error_type"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in why]).alias("detail"))
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    terms, codes = canonical_terms(element, answer, config.ELEMENT_KEYWORDS), extract.element_codes(element, answer)

    def lost(evidence: str, source: str, kind: str) -> Column:
        body = text.clean_text(text.default(c(source)))
        cleaned = F.transform(F.coalesce(evidence, none), lambda t: text.clean_text(text.default(t)))
        return F.transform(F.filter(cleaned, lambda t: ~found(t, body)), lambda t: issue(kind, F.substring(t, 1, 120)))

    always = [
        F.when(own != element, issue("qa_id_element_mismatch", "qa_id_element=", own)), F.when(domain != element, issue("task_domain_element_mismatch", "task_domain=", domain)),
        F.when(~known, issue("unknown_element", element)),
    ]
    checks = [
        F.when(terms_ != terms, issue("answer_terms_not_current_answer_element", "actual=", listed(terms_), "; expected=", listed(terms))),
        F.when(F.filter(codes_, lambda s: s != "") != codes, issue("standards_not_current_answer_element", "actual=", listed(F.filter(codes_, lambda s: s != "")), "; expected=", listed(codes))),
        *[F.when((element == e) & match.contains_any(flat, markers), issue(kind, "")) for e, (kind, markers) in config.RECHECK_MARKERS.items()],
        F.when(match.contains_any(blob, config.OLD_TABLES), issue("references_old_qa_dataset", "qa_v3/qa_v4 reference found")),
    ]
    sources = F.concat(lost("approval_evidence", "approval", "approval_evidence_not_found"), lost("report_evidence", "report", "report_evidence_not_found"))
    deeper = F.when(known, F.concat(match.present(checks), sources)).otherwise(F.slice(sources, 1, 0))
    return rows.select("qa_id", "pair_id", "element", F.explode(F.concat(match.present(always), deeper)).alias("i")).select("qa_id", "pair_id", "element", "i.*")


def pair_integrity(pairs: DataFrame, needed: Sequence[str] = ("report", "approval", "pair_metadata")) -> DataFrame:
    """pair_id and the parts that are missing or empty."""
    missing = match.reasons([(F.coalesce(F.col(n), F.lit("")) == "", f"missing_{n}") for n in needed])
    return pairs.select("pair_id", missing.alias("missing")).where(F.size("missing") > 0)


def pair_errors(pairs: DataFrame, fields: Sequence[str] = ("company", "project_name", "report_source", "approval_source")) -> DataFrame:
    """What is wrong with pair folders (pair_id, report, approval, pair_metadata: JSON text, null where a file is missing),
    a row each: pair_id, error_type, field and detail. Missing and empty files; metadata that is no JSON; required fields
    that are missing, null or blank; and sources of more than one pair, a row for each of the pairs."""
    meta = F.col("pair_metadata")
    value = lambda name: F.trim(F.coalesce(F.get_json_object(meta, f"$.{name}"), F.lit("")))
    source = lambda side: F.coalesce(*[F.nullif(value(f"{side}_{n}"), F.lit("")) for n in ("source", "file_original")])
    error = lambda check, kind, field, detail="": F.when(check, F.struct(F.lit(kind).alias("error_type"), F.lit(field).alias("field"), F.lit(detail).alias("detail")))
    formed = meta.isNotNull() & F.try_parse_json(meta).isNotNull()
    errors = [error(F.coalesce(F.col(name), F.lit("")) == "", "missing_or_empty_file", name) for name in ("report", "approval", "pair_metadata")]
    errors += [error(meta.isNotNull() & F.try_parse_json(meta).isNull(), "metadata_parse_error", "pair_metadata")]
    errors += [error(formed & (value(name) == ""), "metadata_required_field_empty", name) for name in fields]
    out = pairs.select("pair_id", F.explode(match.present(errors)).alias("e")).select("pair_id", "e.*")
    for side in ("report", "approval"):
        told = pairs.where(formed).select("pair_id", source(side).alias("detail")).where("detail is not null")
        repeated = told.groupBy("detail").agg(F.count("*").alias("n")).where("n > 1").select("detail")
        out = out.unionByName(told.join(repeated, "detail").select("pair_id", F.lit(f"duplicate_{side}_source").alias("error_type"), F.lit(f"{side}_source").alias("field"), "detail"))
    return out


def library_errors(rules: DataFrame, high: DataFrame, key: str = "qa_id") -> DataFrame:
    """rule_id, error_type, field and detail: ids that rules (rule_id, level, industry_code, source_qa_ids) cite and the
    high tier doesn't have, as often as they are cited, and rules of level A without an industry."""
    cited = rules.select("rule_id", F.explode("source_qa_ids").alias(key))
    lost = cited.join(high.select(key).distinct(), key, "left_anti").select("rule_id", F.lit("source_qa_id_not_in_qa_strict_high").alias("error_type"), F.lit("source_qa_ids").alias("field"), F.col(key).cast("string").alias("detail"))
    blank = rules.where((F.col("level") == "A") & (F.trim(F.coalesce("industry_code", F.lit(""))) == ""))
    return lost.unionByName(blank.select("rule_id", F.lit("A_rule_empty_industry_code").alias("error_type"), F.lit("industry_code").alias("field"), F.lit("").alias("detail")))


def four_parts(report: Column, approval: Column, codes: Column, issues: Column) -> Column:
    """25 points each for evidence of the report and of the decision, codes, and a match without issues: struct of score
    and reasons. The arrays may be null."""
    held = lambda xs: F.coalesce(F.exists(xs, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(False))
    some = lambda xs: F.coalesce(F.size(xs), F.lit(0)) > 0
    checks = [(held(report), F.lit("no_report_evidence")), (held(approval), F.lit("no_approval_evidence")), (some(codes), F.lit("no_standards")), (~some(issues), F.concat(F.lit("match_issues: "), F.array_join(F.slice(issues, 1, 2), ";")))]
    return F.struct(added([(check, 25) for check, _ in checks]).alias("score"), match.present([F.when(~check, reason) for check, reason in checks]).alias("reasons"))


def lessened(faults: Sequence[tuple[Column, str, int]], base: int = 100, least: int = 10) -> Column:
    """A base less the points of each fault, and the faults: struct of score and issues."""
    score = F.lit(base)
    for check, _, points in faults:
        score = score - F.when(check, points).otherwise(0)
    return F.struct(F.greatest(F.lit(least), score).alias("score"), match.reasons([(check, name) for check, name, _ in faults]).alias("issues"))


def generated_quality(question: Column, answer: Column, codes: Column, evidence: Column) -> Column:
    """The score of a row as it is generated; missing texts and arrays are empty."""
    q, a = (F.coalesce(x, F.lit("")) for x in (question, answer))
    held = F.coalesce(F.exists(evidence, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(False))
    return lessened([
        (F.length(q) < 30, "question too short", 10), (F.length(a) < 50, "answer too short", 15), (F.coalesce(F.size(codes), F.lit(0)) <= 0, "no standards", 20), (~held, "no evidence", 15),
        (~F.contains(a, F.lit("标准")) & ~F.contains(a, F.lit("排放")), "answer lacks standards reference", 10),
    ])


def checked_quality(question: Column, answer: Column, codes: Column, evidence: Column, validation: Column) -> Column:
    """The score of a row that is checked afterwards; missing texts and arrays are empty."""
    none = lambda xs: F.coalesce(F.size(xs), F.lit(0)) <= 0
    return lessened([
        (F.length(F.coalesce(question, F.lit(""))) < 15, "short question", 10), (F.length(F.coalesce(answer, F.lit(""))) < 20, "short answer", 10), (none(codes), "no standards", 20), (none(evidence), "no evidence", 20),
        (F.coalesce(validation, F.lit("")) != "已验证", "not validated", 10),
    ])


def orphans(rules: DataFrame, sources: DataFrame, array: str, key: str) -> DataFrame:
    """Ids that rules cite and no source has."""
    cited = rules.select("rule_id", F.explode(array).alias(key))
    return cited.join(sources.select(key).distinct(), key, "left_anti")


def self_evidence(rows: DataFrame) -> DataFrame:
    """Rows (company, report, approval, evidence, terms) with what their own texts support: the company's
    first CJK characters on both sides, the evidence's start in the report, any term in the decision."""
    key = F.substring(text.cjk_only(F.col("company")), 1, 6)
    rows = rows.withColumn("company_found", (key != "") & F.contains("report", key) & F.contains("approval", key))
    rows = rows.withColumn("evidence_found", found(F.substring("evidence", 1, 50), F.col("report")))
    return rows.withColumn("terms_found", F.exists("terms", lambda t: F.contains(F.col("approval"), t)))


def heuristics(question: Column, answer: Column, codes: Column, evidence: Column, validation: Column) -> dict[str, Column]:
    """Five scores of a row, each a base and what is added up to 100, and their mean."""
    q, a = (lambda t: F.contains(question, F.lit(t))), (lambda t: F.contains(answer, F.lit(t)))
    coded = F.size(codes) > 0
    n_evidence = F.size(F.filter(evidence, lambda x: (F.length(x) > 20) & ~F.contains(x, F.lit("td>"))))
    formed = F.exists(codes, lambda s: s.rlike(r"(?U)^[A-Z]{2}\d+"))
    scores = {
        "grounding": added([(F.length(answer) > 50, 15), (coded, 20), (n_evidence > 0, 25), ((n_evidence > 0) & coded, 10)], 30),
        "specificity": added([(q("标准"), 10), (q("多少") | q("类别") | q("类标准"), 10), (q("排放") | q("去向") | q("限值"), 10), (F.length(question) > 30, 10), (a("标准"), 10), (answer.rlike(r"(?U)[GBDB]\w+"), 20)], 30),
        "professional": added([(coded, 25), (formed, 15), (a("执行"), 10), (a("排放"), 10), (a("标准"), 10)], 30),
        "generalization": F.when(validation == "已验证", 90).when(F.contains(validation, F.lit("参考")), 60).otherwise(50),
        "usefulness": added([*[(q(t), 7) for t in ("标准", "排放", "限值", "处理", "措施", "总量", "识别", "因子", "监测", "验收")], (coded, 15), (F.length(answer) > 100, 10)], 30),
    }
    total = F.lit(0)
    for s in scores.values():
        total = total + s
    return scores | {"overall": total / len(scores)}


def foreign_inputs(frame: DataFrame, allowed: Sequence[str]) -> list[str]:
    """The files a frame reads that lie under none of the allowed folders."""
    return sorted(f for f in frame.inputFiles() if not any(a in f for a in allowed))
