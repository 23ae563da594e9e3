"""The document pipeline and requirement mining on a handful of written texts."""

from __future__ import annotations

import pytest

from docev import config
from docev.plans import requirements, strict

NAMES = ["甲辰五金", "乙巳塑料", "丙午家具"]


def report(name):
    return (
        f"建设项目环境影响报告表\n项目名称：{name}有限公司新建项目\n建设单位：{name}有限公司\n建设项目基本情况 建设项目工程分析 区域环境质量现状 国民经济行业类别 C3311\n建设地点：大良某某路一号\n2022年5月\n"
        f"{'正文' * 300}{name}有限公司生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001 标准。{'正文' * 300}厂界噪声经隔声减振后达标，昼间执行 GB12348-2008 标准。{'正文' * 300}"
    )


def approval(name):
    return (
        f"关于{name}有限公司新建项目环境影响报告表的批复\n{name}有限公司：你单位报批的《{name}有限公司新建项目环境影响报告表》收悉。经研究，批复如下：我局同意你单位建设，从生态环境保护角度可行。主动公开。\n"
        f"一、生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001 标准。二、厂界噪声经隔声减振后达标，昼间执行 GB12348-2008 标准。三、依法办理排污许可，落实三同时制度并开展验收工作。\n佛山市生态环境局 2023年3月5日"
    )


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(f"/r/{n}.md", report(n), 1, "ok") for n in NAMES] + [(f"/a/{n}.md", approval(n), 1, "ok") for n in NAMES] + [("/x/none.txt", "无关", 1, "ok"), ("/x/empty.txt", "", 0, "ok")]
    return spark.createDataFrame(rows, "path string, body string, length int, parse_status string")


@pytest.fixture(scope="module")
def out(bodies):
    return strict.run(bodies)


def test_files_and_records(out):
    kinds = {r.path: r.kind for r in out["files"].collect()}
    assert [kinds[f"/{d}/{n}.md"] for d in "ra" for n in NAMES] == ["report"] * 3 + ["approval"] * 3 and kinds["/x/none.txt"] == kinds["/x/empty.txt"] == "unknown"
    row = out["reports"].where("source_file like '%甲辰%'").first()
    assert (row.company, row.project_name, row.industry_code, row.project_type, row.town, row.year) == ("甲辰五金有限公司", "甲辰五金有限公司新建项目", "C3311", "新建", "大良", "2022")
    row = out["approvals"].where("source_file like '%甲辰%'").first()
    assert (row.company, row.approval_date, row.report_type_referenced, row.approval_mode) == ("甲辰五金有限公司", "2023-03-05", "报告表", "普通批复")


def test_pairs_are_one_to_one(out):
    clean = out["clean"].select("report_source", "approval_source").collect()
    assert {(r.report_source[3:], r.approval_source[3:]) for r in clean} == {(f"{n}.md", f"{n}.md") for n in NAMES} and out["unmatched_reports"].count() == 0


def test_questions_hold_their_evidence(out):
    rows = out["questions"].collect()
    assert {(r.pair_id, r.element) for r in rows} == {(f"pair_0000{k}", e) for k in (1, 2, 3) for e in ("废水", "噪声")}
    for r in rows:
        flat = " ".join(r.approval.split())
        span = r.approval_span
        assert flat[span.char_start : span.char_end] == span.text and all(t in r.answer for t in r.answer_terms)


def test_tiers_and_rules(out):
    rows = out["audited"].collect()
    assert {(r.element, r.tier) for r in rows} == {("废水", "high"), ("噪声", "high")}, [(r.qa_id, r.issues) for r in rows]
    assert {(r.element, r.evidence_level, r.support_count) for r in out["rules"].collect()} == {("废水", "A", 3), ("噪声", "A", 3)}
    assert out["triples"].where("relation = 'USES_STANDARD'").count() == 2


def test_an_earlier_high_row_with_issues_stays_down(out, spark):
    asked = out["questions"].withColumn("task_domain", out["questions"].element)
    bad = asked.selectExpr("*").drop("codes").selectExpr("*", "array('GB1') as codes")
    found = strict.audited(bad, bad.select("qa_id"))
    assert {(r.tier, r.score <= 40) for r in found.collect()} == {("review", True)}


def test_requirements(bodies):
    found = requirements.run(bodies)
    kinds = {r.source_md: (r.doc_type, r.valid_approval_text, r.approval_conclusion) for r in found["inventory"].collect()}
    assert kinds["/a/甲辰五金.md"] == ("报告表普通批复", True, "同意") and kinds["/r/甲辰五金.md"][0] == "wrong_type_report" and kinds["/x/none.txt"][0] == "invalid_or_unknown"
    held = {(r.requirement_type, r.standards) for r in found["requirements"].collect()}
    assert ("废水要求", "DB44/26-2001") in held and ("噪声要求", "GB12348-2008") in held
    by = {r.requirement_type: r for r in found["summary"].collect()}
    assert by["废水要求"]["count"] == 3 and by["废水要求"].ratio == 1.0 and by["废水要求"].suitable_for_qa
    gate = found["gate"].first()
    assert not gate.passed and gate.valid == 3 and gate.wrong == 3


def test_every_category_has_terms():
    assert set(config.HIGH_VALUE) | set(config.MEDIUM_VALUE) <= set(config.REQUIREMENTS)
