"""The document pipeline from end to end: classified files to records, linked pairs, question rows with
evidence, audited tiers, rules and a graph. Each stage is a function of DataFrames; the caller decides
what is written between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, session
from ..functions import extract, match, spans, text
from ..operators import aggregate, audit, link, rules, segment

PREFIX = "批复要求："


def classified(bodies: DataFrame) -> DataFrame:
    """``bodies`` (path, body, length, parse_status) with file_id, kind, confidence and evidence_text."""
    head = text.clean_text(F.substring("body", 1, 12000))
    rows = bodies.withColumn("head", head)
    rows = rows.withColumn("k", match.priority(F.col("head"), config.REPORT_KEYWORDS, config.APPROVAL_KEYWORDS, config.PUBLIC_KEYWORDS))
    around = lambda terms: spans.around_first(F.col("head"), terms)
    evidence = F.when(F.col("k.type") == "public_participation", around(config.PUBLIC_KEYWORDS)).when(F.col("k.type") == "approval", around(config.APPROVAL_KEYWORDS)).when(F.col("k.type") == "report", around(config.REPORT_KEYWORDS)).otherwise(F.substring("head", 1, 300))
    rows = rows.withColumn("evidence_text", evidence).withColumn("kind", F.col("k.type")).withColumn("confidence", F.col("k.confidence"))
    return aggregate.numbered(rows.drop("head", "k"), "file_id", "F%06d", F.col("path"))


def report_records(files: DataFrame) -> DataFrame:
    body = F.col("body")
    rows = aggregate.numbered(files.where("kind = 'report'"), "report_id", "R%05d", F.col("path"))
    return rows.select(
        "report_id", F.col("path").alias("source_file"), F.col("kind").alias("detected_file_type"), extract.project_name(body).alias("project_name"),
        extract.company(body).alias("company"), extract.company(body).alias("construction_unit"), extract.industry_code(body).alias("industry_code"), F.lit("").alias("industry_name"),
        extract.project_type(body).alias("project_type"), extract.report_type(body).alias("report_type"), extract.town(body).alias("town"),
        extract.first_match(body, config.LOCATION_PATTERNS).alias("construction_location"), extract.year(body, F.col("path")).alias("year"), "parse_status",
        F.substring(text.clean_text(body), 1, 800).alias("evidence_text"), "body",
    )


def approval_records(files: DataFrame) -> DataFrame:
    body = F.col("body")
    rows = aggregate.numbered(files.where("kind = 'approval'"), "approval_id", "A%05d", F.col("path"))
    rows = rows.withColumn("title", F.coalesce(F.nullif(extract.title(body), F.lit("")), extract.first_match(body, config.TITLE_PATTERNS)))
    lead = F.concat("title", F.lit("\n"), F.substring(body, 1, 6000))
    mode = match.ladder(F.substring(body, 1, 8000), [(["承诺制", "告知承诺"], "承诺制"), (["形式审查"], "形式审查")], "普通批复")
    return rows.select(
        "approval_id", F.col("path").alias("source_file"), F.col("kind").alias("detected_file_type"), F.col("title").alias("approval_title"),
        extract.doc_no(body, F.col("path")).alias("approval_doc_no"), extract.date(body, F.col("path")).alias("approval_date"), extract.project_name(lead).alias("project_name"),
        extract.company(lead).alias("company"), extract.report_type(body).alias("report_type_referenced"), mode.alias("approval_mode"),
        extract.first_match(body, config.AUTHORITY_PATTERNS).alias("approval_authority"), "parse_status", F.substring(text.clean_text(body), 1, 800).alias("evidence_text"), "body",
    )


def pairs(reports: DataFrame, approvals: DataFrame, matching: config.Matching = config.Matching()) -> DataFrame:
    """Linked records with pair_status. Reports without a block of their own meet the approvals
    of companies similar enough to be scored."""
    c = F.col
    left = reports.select(
        "report_id", c("company").alias("report_company"), c("project_name").alias("report_project"), "report_type", c("project_type").alias("report_project_type"), c("town").alias("report_town"),
        c("year").alias("report_year"), c("detected_file_type").alias("report_kind"), link.block_key(c("company"), matching.block).alias("block"),
    )
    right = approvals.select(
        "approval_id", c("company").alias("approval_company"), c("project_name").alias("approval_project"), c("report_type_referenced").alias("approval_type"),
        extract.project_type(c("body"), c("project_name")).alias("approval_project_type"), extract.town(c("body")).alias("approval_town"), "approval_date", c("detected_file_type").alias("approval_kind"),
        "approval_title", c("evidence_text").alias("approval_evidence"), link.block_key(c("company"), matching.block).alias("block"),
    )
    found = link.scored(link.candidates(left, right, "block", alike=("report_company", "approval_company", matching.least_company)), matching)
    return link.assigned(found, "report_id", "approval_id", [c("report_id"), c("approval_id")], matching)


def clean_pairs(linked: DataFrame, reports: DataFrame, approvals: DataFrame) -> DataFrame:
    """pair_id, both texts and the pair's metadata, for clean pairs."""
    kept = linked.where("pair_status = 'clean'").select("report_id", "approval_id", "match_score")
    kept = aggregate.numbered(kept, "pair_id", "pair_%05d", F.desc("match_score"), F.col("report_id"))
    mine = reports.select("report_id", F.col("body").alias("report"), "company", "project_name", "industry_code", "industry_name", "project_type", "report_type", F.col("source_file").alias("report_source"))
    theirs = approvals.select("approval_id", F.col("body").alias("approval"), "approval_doc_no", "approval_date", F.col("source_file").alias("approval_source"))
    return kept.join(mine, "report_id").join(theirs, "approval_id")


def _relevant(element: str, sentence: Column) -> Column:
    held = match.contains_any(sentence, config.ELEMENT_KEYWORDS[element])
    stricter = {"噪声": config.NOISE_STRICT, "危废": config.HAZARD_STRICT}.get(element)
    return held & match.contains_any(sentence, stricter) if stricter else held


def _focused(element: str, sentence: Column) -> Column:
    terms = [*config.ELEMENT_KEYWORDS[element], *config.SUPPORT_TERMS[element]]
    if element != "危废":
        return spans.focus(sentence, terms)
    enough = lambda joined: F.contains(joined, F.lit("GB18597")) & match.contains_any(joined, ["委托", "有资质"])
    found = spans.anchored(sentence, config.HAZARD_ANCHORS, enough, clean=extract.without_other_codes)
    return F.when(found != "", found).otherwise(extract.without_other_codes(spans.focus(sentence, terms)))


def _answer(element: str, sentences: Column) -> Column:
    own = F.transform(F.filter(sentences, lambda s: _relevant(element, s)), lambda s: _focused(element, s))
    body = F.btrim(F.array_join(spans.until(own), "。"), F.lit("。"))
    return F.when(body != "", F.concat(F.lit(PREFIX), body, F.lit("。"))).otherwise(F.lit(""))


def questions(clean: DataFrame) -> DataFrame:
    """One row a pair and element with an answer: codes, terms, evidence on both sides with offsets in
    the cleaned texts."""
    rows = clean.withColumn("flat_report", text.clean_text(F.col("report"))).withColumn("flat_approval", text.clean_text(F.col("approval")))
    rows = rows.withColumn("sentences", segment.sentence_array(F.col("flat_approval")))
    answers = F.array(*[F.struct(F.lit(e).alias("element"), _answer(e, F.col("sentences")).alias("answer")) for e in config.ELEMENT_KEYWORDS])
    rows = rows.withColumn("a", F.explode(answers)).select("*", "a.*").drop("a", "sentences").where("answer != ''")
    rows = session.checkpointed(rows)  # each answer is made once, however often it is read below
    element, answer = F.col("element"), F.col("answer")
    rows = rows.withColumn("codes", extract.element_codes(element, answer)).withColumn("answer_terms", audit.canonical_terms(element, answer, config.ELEMENT_KEYWORDS))
    body = F.btrim(F.replace(answer, F.lit(PREFIX)), F.lit("。"))
    windows = F.when(F.lit(False), spans.best_window(F.col("flat_report"), ["-"], F.col("answer_terms")))
    for e, terms in config.ELEMENT_KEYWORDS.items():
        windows = windows.when(element == e, spans.best_window(F.col("flat_report"), terms, F.col("answer_terms"), config.EXCLUDED_MARKERS))
    rows = rows.withColumn("approval_span", spans.anchor_search(F.col("flat_approval"), body, F.col("answer_terms"))).withColumn("report_span", windows)
    kind = F.coalesce(F.nullif(match.ladder(F.col("project_name"), config.PROJECT_TYPES[:6]), F.lit("")), F.col("project_type"))
    ask = F.concat(F.lit("【区级】"), F.substring("company", 1, 28), F.lit("（"), kind, F.lit("项目）"), text.looked_up(element, config.QUESTIONS))
    return rows.select(
        F.concat_ws("_", F.lit("QA"), "pair_id", element).alias("qa_id"), "pair_id", "company", "project_name", "industry_code", "industry_name", kind.alias("project_type"), "report_type", "element",
        element.alias("task_domain"), ask.alias("question"), "answer", "codes", "answer_terms", "approval_span", "report_span", F.col("approval_span.text").alias("approval_evidence"),
        F.coalesce("report_span.text", F.lit("")).alias("report_evidence"), "report", "approval", F.col("company").alias("meta_company"),
    )


def audited(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Question rows with issues, tier and score; ``previous``: the qa_ids of an earlier high tier."""
    blob = text.blob([F.col(c) for c in ("question", "answer", "approval_evidence", "report_evidence")], [F.col("answer_terms"), F.col("codes")])
    rows = rows.withColumn("blob", blob)
    found = session.checkpointed(audit.strict(rows).drop("blob", "report", "approval", "meta_company"))
    issues = session.checkpointed(audit.field_issues(rows))
    return audit.sticky(found, found.limit(0).select("qa_id") if previous is None else previous, issues)


def library(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of the high tier, and their triples."""
    made = rules.induced(found.where("tier = 'high'"))
    return made, rules.triples(made)


def run(bodies: DataFrame) -> dict[str, DataFrame]:
    """All stages, by name, each written before the next reads it."""
    keep = session.checkpointed
    files = keep(classified(bodies))
    reports, approvals = keep(report_records(files)), keep(approval_records(files))
    linked = keep(pairs(reports, approvals))
    clean = keep(clean_pairs(linked, reports, approvals))
    asked = keep(questions(clean))
    found = keep(audited(asked))
    made, edges = library(found)
    alone = link.unmatched(reports, linked.where("pair_status = 'clean'"), "report_id")
    return {"files": files, "reports": reports, "approvals": approvals, "pairs": linked, "unmatched_reports": alone, "clean": clean, "questions": asked, "audited": found, "rules": keep(made), "triples": keep(edges)}
