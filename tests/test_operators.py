"""Operators on small frames: invariants, boundary values and plain versions."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docev import config
from docev.functions import extract, fuzzy
from docev.operators import aggregate, assign, audit, judge, link, rules, segment, stats, tracing
from docev.sources import readers, sinks
from docev.streaming import delivery


# --- segmentation ---------------------------------------------------------------------------


def test_sentences_break_before_the_project(spark):
    body = "本项目位于某镇某路三号之内。项目生产废水经处理后排入管网 本项目废气经收集后高空排放；短句。"
    found = spark.createDataFrame([(body,)], "x string").select(segment.sentence_array(F.col("x")).alias("s")).first().s
    assert found == ["本项目位于某镇某路三号之内", "项目生产废水经处理后排入管网", "本项目废气经收集后高空排放"]


def test_lines_carry_their_heading(spark):
    frame = spark.createDataFrame([(1, "a\n# One\nb\n\nc\n# Two\nd"), (2, "")], "id long, body string")
    rows = segment.lines(frame, "body", ["id"]).orderBy("line_start").collect()
    assert [(r.line_start, r.section_title, r.text) for r in rows] == [(1, "", "a"), (2, "One", "# One"), (3, "One", "b"), (5, "One", "c"), (6, "Two", "# Two"), (7, "Two", "d")]


def test_the_last_of_repeated_sections_wins(spark):
    frame = spark.createDataFrame([(1, "前言\n一、甲\n乙\n二、丙\n一、丁")], "id long, body string")
    assert segment.sections(frame, "body", ["id"]).first().sections == {"一": "一、丁", "二": "二、丙"}


def test_conditions(spark):
    frame = spark.createDataFrame([(1, "废水执行 DB44/26-2001，COD：40mg/L。噪声达标")], "id long, body string")
    found = segment.conditions(frame, F.col("body"), ["id"], {"废水": ["废水"], "噪声": ["噪声"], "危废": ["危废"]}).first().conditions
    assert set(found) == {"废水", "噪声"} and found["废水"].standards == ["DB44/26-2001"] and found["废水"].limits[0].value == 40.0


def test_split_elements(spark):
    frame = spark.createDataFrame([(1, ["废水", "噪声"], "废水一。噪声二。废水三"), (2, ["废水"], "都在")], "id long, e array<string>, a string")
    rows = {(r.id, r.element): r.a for r in segment.split_elements(frame, "e", "a", {"废水": ["废水"], "噪声": ["噪声"]}).collect()}
    assert rows == {(1, "废水"): "废水一；废水三", (1, "噪声"): "噪声二", (2, "废水"): "都在"}
    assert [r["index"] for r in segment.first_exploded(frame, "e", 1, "x").collect()] == [1, 1]


# --- linkage --------------------------------------------------------------------------------


def _greedy(edges):
    left, right, out = set(), set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in left and b not in right:
            out.add((a, b, s))
            left.add(a)
            right.add(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_greedy_pass(spark, seed):
    draw = np.random.default_rng(seed)
    edges = list({(int(a), int(b)): (int(a), int(b), int(s)) for a, b, s in zip(draw.integers(0, 12, 60), draw.integers(0, 12, 60), draw.integers(0, 6, 60))}.values())
    frame = spark.createDataFrame(edges, "a long, b long, s long")
    assert {tuple(r) for r in assign.one_to_one(frame, "a", "b", [F.desc("s"), F.col("a"), F.col("b")]).collect()} == _greedy(edges)


def test_chain_of_ties(spark):
    edges = [(k, k, 5) for k in range(6)] + [(k, k + 1, 5) for k in range(6)]
    frame = spark.createDataFrame(edges, "a long, b long, s long")
    assert {tuple(r) for r in assign.one_to_one(frame, "a", "b", [F.desc("s"), F.col("a"), F.col("b")]).collect()} == _greedy(edges)
    assert assign.one_to_one(frame.limit(0), "a", "b", [F.col("a")]).count() == 0


def test_assignment_statuses(spark):
    rows = [("r1", "a1", 95.0, []), ("r1", "a2", 92.0, []), ("r2", "a2", 91.0, []), ("r3", "a3", 85.0, []), ("r3", "a1", 84.0, []), ("r4", "a4", 96.0, ["x"]), ("r4", "a1", 97.0, ["x"]), ("r5", "a5", 79.9, []), ("r6", "a6", 80.0, []), ("r7", "a7", 89.9, [])]
    frame = spark.createDataFrame(rows, "r string, a string, match_score double, rejects array<string>")
    found = {(x.r, x.a): x.pair_status for x in link.assigned(frame, "r", "a", [F.col("r"), F.col("a")]).collect()}
    assert found == {("r1", "a1"): "clean", ("r2", "a2"): "clean", ("r3", "a3"): "candidate", ("r4", "a4"): "candidate", ("r4", "a1"): "candidate", ("r5", "a5"): "mismatch", ("r6", "a6"): "candidate", ("r7", "a7"): "candidate"}


def test_scoring_and_rejects(spark):
    pair = {"report_company": "某某五金有限公司", "approval_company": "某某五金有限公司", "report_project": "某某五金新建项目一期工程", "approval_project": "某某五金新建项目一期工程", "report_type": "报告表", "approval_type": "报告书", "report_project_type": "新建", "approval_project_type": "新建",
            "report_town": "", "approval_town": "大良", "report_year": "2022", "approval_date": "2023-01-02", "report_kind": "report", "approval_kind": "approval", "approval_title": "新建", "approval_evidence": "", "approval_project2": ""}
    frame = spark.createDataFrame([tuple(pair.values())], list(pair))
    row = link.scored(frame).first()
    assert row.match_score == pytest.approx(100 * 0.4 + 100 * 0.35 + 0 + 100 * 0.05 + 50 * 0.05 + 100 * 0.05) and row.rejects == ["report_type_mismatch"]
    assert link.scored(frame.withColumn("report_company", F.lit(""))).count() == 0


def test_block_keys_and_candidates(spark):
    frame = spark.createDataFrame([("佛山市顺德区某某五金制品有限公司",), ("广东甲乙厂",)], "x string")
    assert [r.k for r in frame.select(link.block_key(F.col("x")).alias("k")).collect()] == ["某某五金", "甲乙"]
    left, right = spark.createDataFrame([(1, "a"), (2, "z")], "l int, k string"), spark.createDataFrame([(10, "a"), (11, "b")], "r int, k string")
    assert {(x.l, x.r) for x in link.candidates(left, right, "k").collect()} == {(1, 10), (2, 10), (2, 11)}
    assert {(x.l, x.r) for x in link.candidates(left, right, "k", fallback=False).collect()} == {(1, 10)}


def test_containing(spark):
    texts = spark.createDataFrame([(1, "xa long word here"), (2, "a longer word"), (3, "word"), (4, None), (5, "a  long  word")], "id int, x string")
    needles = spark.createDataFrame([(1, "a long wo"), (2, "word"), (3, "a  long"), (4, "")], "k int, needle string")
    expected = {(i, k) for i, x in ((1, "xa long word here"), (2, "a longer word"), (3, "word"), (5, "a  long  word")) for k, n in ((1, "a long wo"), (2, "word"), (3, "a  long"), (4, "")) if n in x}
    assert {(r.id, r.k) for r in link.containing(texts, "x", needles, "needle").collect()} == expected


@pytest.mark.parametrize("seed", range(3))
def test_similar_names_are_all_found(spark, seed):
    draw = np.random.default_rng(seed)
    names = [["".join(draw.choice(list("abcdefgh"), draw.integers(1, 12))) for _ in range(60)] for _ in range(2)]
    left, right = ([*xs, xs[0], "", None, "a" * 40] for xs in names)
    frames = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    for least in (60.0, 70.0, 100.0):
        expected = {(x, y) for x in left for y in right if x and y and fuzzy.similar(x, y) >= least}
        found = [tuple(r) for r in link.similar_names(*frames, "l", "r", least).collect()]
        assert set(found) == expected and len(found) == len(expected)


def test_candidates_by_similar_names(spark):
    left = spark.createDataFrame([(1, "a", "xx"), (2, "z", "abcdefg"), (3, "z", None), (4, None, "abcdefg")], "l int, k string, mine string")
    right = spark.createDataFrame([(10, "a", "none"), (11, "b", "abcdef"), (12, "b", "qrst"), (13, "c", "abcdef"), (14, None, "abcdefg")], "r int, k string, theirs string")
    found = link.candidates(left, right, "k", alike=("mine", "theirs", 70.0))
    assert sorted((x.l, x.r) for x in found.collect()) == [(1, 10), *((i, r) for i in (2, 4) for r in (11, 13, 14))]
    assert link.candidates(left.limit(0), right, "k", alike=("mine", "theirs", 70.0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_title_lookup(spark, seed):
    draw = np.random.default_rng(seed)
    some = lambda n: ["".join(draw.choice(list("ab "), draw.integers(0, 9))) for _ in range(n)]
    left, right = [*some(40), "aabb", "aabb", None], [*some(25), None, "a b a", "aba" * 9]
    found = link.title_lookup(spark.createDataFrame(list(enumerate(left)), "id int, x string"), spark.createDataFrame(list(enumerate(right)), "o int, t string"), "x", "t", "o", core=4)

    def plain(x):
        bare = lambda s: s.replace(" ", "")
        known = [(o, bare(t)) for o, t in enumerate(right) if t is not None]
        if x is None:
            return None, "none"
        x = bare(x)
        if equal := [o for o, t in known if t == x]:
            return equal[0], "equal"
        near = [o for o, t in known if len(x) >= 4 and len(t) >= 4 and (x[:4] in t or t[:4] in x)]
        return (near[0], "contained") if near else (None, "none")

    assert sorted((r.id, r.m.o if r.m else None, r.how) for r in found.collect()) == [(i, *plain(x)) for i, x in enumerate(left)]


def test_query_sets_in_blocks(spark):
    held = spark.createDataFrame([(k, "x" * k) for k in range(50)], "k int, x string")
    for most in ({"rows": 7}, {"size": 300}, {}):
        parts = [[r.k for r in b.collect()] for b in link.blocks(held, "x", **most)]
        assert sorted(k for p in parts for k in p) == list(range(50)) and (len(parts) > 1) == bool(most)
    assert [b.count() for b in link.blocks(held.limit(0), "x")] == [0]


def plain_one_sided(edges):
    """Left rows in order, each over its edges in order; only clean pairs consume."""
    used, out = set(), []
    for left in sorted({e[0] for e in edges}):
        best, at = 0, None
        for _, right, score, company in sorted(e for e in edges if e[0] == left):
            if right not in used and company >= 30 and score > best:
                best, at = score, (right, company)
        if at and (at[1] >= 90 or best >= 80):
            is_clean = at[1] >= 90 or best >= 90
            out.append((left, at[0], "clean" if is_clean else "needs_review"))
            used |= {at[0]} if is_clean else set()
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_one_sided_takes_in_order(spark, seed):
    draw = np.random.default_rng(seed)
    edges = [(a, b, float(draw.choice([70, 80, 85, 90, 95])), float(draw.choice([20, 30, 60, 90, 100]))) for a in range(12) for b in range(8) if draw.random() < 0.5]
    found = assign.one_sided(spark.createDataFrame(edges, "a long, b long, s double, c double"), "a", "b", "a", "b", "s", "c")
    assert sorted((r.a, r.b, r.pair_status) for r in found.collect()) == plain_one_sided(edges)
    assert assign.one_sided(spark.createDataFrame([], "a long, b long, s double, c double"), "a", "b", "a", "b", "s", "c").count() == 0


def test_lookups(spark):
    left = spark.createDataFrame([("p1", "甲", "n1"), ("p2", "乙", "n2"), ("p3", "丙", "")], "id string, name string, no string")
    right = spark.createDataFrame([(1, "甲", "n2"), (2, "乙", "n9"), (3, "丙丙", "n8")], "ord int, rname string, rno string")
    ways = [(F.col("name"), F.col("rname"), 100), (F.col("no"), F.col("rno"), 95)]
    found = {r.id: (r.ord, r.best_score) for r in link.by_certainty(left, right, ways, "id", "ord", F.when(F.contains("rname", F.col("name")), 80.0).otherwise(0.0)).collect()}
    assert found == {"p1": (1, 100.0), "p2": (2, 100.0), "p3": (3, 80.0)}
    regions = spark.createDataFrame([("1", "省", None), ("2", "市", "1"), ("3", "区", "2"), ("8", "甲", "9"), ("9", "乙", "8")], "code string, name string, parent_code string")
    paths = {r.code: r.path for r in link.region_paths(regions).collect()}
    assert paths["3"] == "省/市/区" and paths["8"].endswith("甲")
    assert link.last_by(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string"), "k", ["o"]).first().v == "b"


# --- aggregation ----------------------------------------------------------------------------


def test_witnesses(spark):
    rows = [(1, "i", ["s", "t"], "c1"), (2, "i", ["s"], "c2"), (3, "i", [], "c3"), (4, "j", ["s"], "c1")]
    frame = spark.createDataFrame(rows, "id int, ind string, std array<string>, co string")
    found = {r.id: (r.verified, r.n_values) for r in aggregate.witnessed(frame, "id", ["ind"], "std", "co").collect()}
    assert found == {1: (False, 2), 2: (True, 1), 3: (True, 0), 4: (False, 1)}


def test_lists_and_prefixes(spark):
    rows = [("g", k, f"{'p' * 100}{k}" if k < 3 else f"answer {k} " + "x" * 40) for k in range(9)]
    frame = spark.createDataFrame(rows, "g string, k int, a string")
    found = aggregate.first_by_prefix(frame, ["g"], "a", F.col("k"), n=3).first()["values"]
    assert found == [rows[0][2], rows[3][2], rows[4][2]]
    assert aggregate.first_list(frame, ["g"], F.col("k"), 2, F.desc("k")).first()["values"] == [8, 7]


def test_running_cap_and_ranks(spark):
    frame = spark.createDataFrame([(1, 1, 600), (1, 2, 5), (2, 1, 519), (2, 2, 1), (2, 3, 1)], "g int, k int, n int")
    found = {(r.g, r.k) for r in aggregate.running_until(frame, ["g"], F.col("n"), [F.col("k")], 520).collect()}
    assert found == {(1, 1), (2, 1), (2, 2)}
    ranks = aggregate.average_ranks(spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int"), "v", "r").select("r").collect()
    assert sorted(r.r for r in ranks) == [1.0, 2.5, 2.5, 4.0]


def test_numbers_follow_the_order(spark):
    frame = spark.range(1000).repartition(7).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = aggregate.numbered(frame, "n", "N%04d", F.col("v")).orderBy("v").collect()
    assert [r.n for r in rows] == [f"N{k:04d}" for k in range(1, 1001)] and aggregate.numbered(frame.limit(0), "n", "N%d", F.col("v")).count() == 0


def test_reconciliation_and_gate(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "metric string, value int"), spark.createDataFrame([("x", 1), ("y", 3), ("z", 1)], "metric string, value int")
    assert {r.metric: r.status for r in aggregate.reconciled(a, b).collect()} == {"x": "ok", "y": "error", "z": "info"}
    assert not aggregate.gate(a, {"enough": F.count("*") >= 3, "positive": F.min("value") > 0}).first().passed


# --- audit ----------------------------------------------------------------------------------

REPORT = "某某五金有限公司某某五金新建项目一期工程。生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001。"
APPROVAL = "某某五金有限公司某某五金新建项目一期工程 生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001。"
QA = {
    "qa_id": "q_废水", "pair_id": "pair_00001", "company": "某某五金有限公司", "project_name": "某某五金新建项目一期工程", "element": "废水", "answer": "批复要求：生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001。",
    "task_domain": "废水", "answer_terms": ["DB44/26-2001", "污水", "生活污水", "化粪池", "预处理", "市政污水管网", "排入"], "codes": ["DB44/26-2001"], "approval_evidence": "生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001",
    "report_evidence": "生活污水经化粪池预处理后排入市政污水管网，执行 DB44/26-2001", "blob": "生活污水", "report": REPORT, "approval": APPROVAL, "meta_company": "某某五金有限公司",
}
SCHEMA = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in QA.items())


def audited(spark, **changes):
    row = {**QA, **changes}
    return audit.strict(spark.createDataFrame([tuple(row.values())], SCHEMA)).first()


def test_a_sound_row_is_high(spark):
    row = audited(spark)
    assert (row.tier, row.score, row.issues) == ("high", 100, [])


@pytest.mark.parametrize(("changes", "issue", "tier"), [
    ({"approval": None}, "pair_id_missing", "review"), ({"meta_company": "别的公司"}, "metadata_company_mismatch", "review"), ({"report": REPORT.replace("有限公司", "厂")}, "company_in_report_failed", "medium"),
    ({"qa_id": "q_噪声"}, "qa_id_element_mismatch", "review"), ({"task_domain": "噪声"}, "task_domain_element_mismatch", "review"), ({"answer_terms": []}, "answer_terms_not_current_answer_element", "review"),
    ({"codes": []}, "standards_not_current_answer_element", "review"), ({"report_evidence": "附件清单"}, "report_evidence_not_specific_or_excluded", "review"), ({"element": "光", "qa_id": "q_光", "task_domain": "光"}, "unsupported_element", "review"),
    ({"answer": QA["answer"] + "一、甲二、乙"}, "answer_not_trimmed_to_element", "review"), ({"approval_evidence": "没有的话"}, "approval_evidence_found_failed", "review"),
])
def test_each_issue(spark, changes, issue, tier):
    row = audited(spark, **changes)
    assert issue in row.issues and row.tier == tier
    assert row.score == (0 if issue == "pair_id_missing" else max(60, 100 - 8 * len(row.issues)) if tier == "medium" else max(20, 100 - 10 * len(row.issues)))


def test_sticky_rows(spark):
    rows = spark.createDataFrame([("a", [], "high", 100), ("b", [], "high", 100), ("c", ["x"], "medium", 92), ("d", [], "high", 100)], "qa_id string, issues array<string>, tier string, score int")
    previous, issues = rows.where("qa_id in ('a', 'c')").select("qa_id"), rows.where("qa_id in ('b', 'c')").select("qa_id")
    found = {r.qa_id: (r.tier, r.score, r.issues) for r in audit.sticky(rows, previous, issues).collect()}
    assert found == {"a": ("high", 100, []), "b": ("review", 40, ["field_consistency_failed"]), "c": ("review", 40, ["x", "field_consistency_failed"]), "d": ("high", 100, [])}


def test_field_issues(spark):
    bad = {**QA, "qa_id": "q_噪声", "answer_terms": ["x"]}
    found = audit.field_issues(spark.createDataFrame([tuple(QA.values()), tuple(bad.values())], SCHEMA)).collect()
    assert [(r.qa_id, r.error_field) for r in found] == [("q_噪声", "qa_id/element"), ("q_噪声", "answer_terms")]


def test_traces(spark):
    claims = spark.createDataFrame([("q1", "废水经隔油处理，排入市政管网", "p1"), ("q2", "没有证据的说法，谁也没说过", "p1")], "qa_id string, claim string, project_id string")
    text = "废水经隔油处理，排入市政管网，达标"
    lines = spark.createDataFrame([("approval", "f2", "p1", 3, text), ("report", "f1", "p1", 9, text), ("report", "f1", "p2", 1, text)], "source_type string, source_file string, project_id string, line_start int, text string")
    found = {r.qa_id: (r.support, r.source_type, r.line_start) for r in tracing.traced(claims, lines, {"report": 1, "approval": 2}).collect()}
    assert found == {"q1": ("direct", "report", 9), "q2": ("unsupported", None, None)}
    inside = spark.createDataFrame([("report", "f", "p1", 1, "该项目废水经隔油处理后再排入市政管网中，达标")], lines.schema)
    assert {r.qa_id: r.support for r in tracing.traced(claims, inside, {"report": 1}).collect()} == {"q1": "direct", "q2": "unsupported"}
    short = spark.createDataFrame([("q3", "达标", "p1")], claims.schema)
    assert tracing.traced(short, inside, {"report": 1}, least=1).first().support == "unsupported" and tracing.traced(short, inside, {"report": 1}).first().support == "unsupported"


def test_scores(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    t, f = F.lit(True), F.lit(False)
    assert get(audit.deducted([(t, 30), (f, 50)])) == 70 and get(audit.deducted([(t, 300)])) == 0 and get(audit.deducted([], zero=t)) == 0
    assert get(audit.added([(t, 80), (t, 40)])) == 100 and get(audit.graded(F.lit(85), t)) == "verified" and get(audit.graded(F.lit(85), f)) == "review"
    codes = F.array(F.lit("GB1"))
    assert get(audit.aligned(codes, F.lit("GB1 a"), F.lit("b GB1"))) and not get(audit.aligned(F.array().cast("array<string>"), F.lit("")))


# --- rules and judging ----------------------------------------------------------------------


def test_levels_by_support(spark):
    rows = [(f"i{n}", "e", "t", f"p{k}", f"q{n}{k}", "a" * 300, ["S2", "S1"]) for n in (1, 2, 3, 4) for k in range(n)]
    frame = spark.createDataFrame(rows, "industry_code string, element string, project_type string, pair_id string, qa_id string, answer string, codes array<string>")
    found = {r.industry_code: r for r in rules.induced(frame).collect()}
    assert [found[f"i{n}"].evidence_level for n in (1, 2, 3, 4)] == ["C", "B", "A", "A"]
    assert [round(found[f"i{n}"].confidence, 3) for n in (1, 2, 3, 4)] == [0.333, 0.667, 1.0, 1.0]
    assert found["i2"].common_standards == ["S1", "S2"] and found["i3"].source_qa_ids == ["q30", "q31", "q32"] and len(found["i1"].common_requirements[0]) == 260
    edges = rules.triples(rules.induced(frame), most=2)
    assert {r["head"] for r in edges.where("relation = 'HAS_STRICT_RULE'").collect()} == {"i1", "i2"} and edges.count() == 2 + 2 + 4


def test_mock_judge(spark):
    samples = spark.createDataFrame([(1, "L1_信息抽取", "easy"), (2, "odd", "odd"), (3, "L3_审核推理", "hard")], "sample_id int, task_level string, difficulty string")
    found = {r.sample_id: r for r in judge.mocked(samples).collect()}
    assert [found[k].overall_score for k in (1, 2, 3)] == [78, 72, 65] and [found[k].review_priority for k in (1, 2, 3)] == ["低", "低", "中"] and not found[3].need_human_review
    low = judge.mocked(samples, {}, [45] * 9).first()
    assert low.need_human_review and low.review_priority == "高" and low.final_judgment == "严重缺漏_明显错误" and len(low.weaknesses) == 4 and not low.strengths
    assert judge.evaluated(samples, None, "", "", samples) is samples


def test_json_array(spark, tmp_path):
    for n in (0, 1, 5):
        frame = spark.createDataFrame([(k, "a") for k in range(n)], "id long, v string")
        sinks.json_array(frame, f"file://{tmp_path}/j{n}")
        assert sorted(r["id"] for r in json.loads("".join(p.read_text() for p in (tmp_path / f"j{n}").glob("part-*")))) == list(range(n))


def test_a_scorer_is_used_where_its_answer_parses(spark):
    samples = spark.createDataFrame([(1, "p1"), (2, "p2")], "sample_id int, prompt string")
    fallback = spark.createDataFrame([(1, 10), (2, 20)], "sample_id int, overall_score int")
    told = judge.evaluated(samples, lambda xs: ['{"overall_score": 77}' if x == "p1" else "oops" for x in xs], "prompt", "overall_score int", fallback)
    assert {r.sample_id: r.overall_score for r in told.collect()} == {1: 77, 2: 20}


# --- statistics -----------------------------------------------------------------------------

A, B = [78.0, 82.0, 69.0, 74.0, 69.0], [71.0, 75.0, 62.0, 66.0, 62.0]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(list(zip(A, B)), "a double, b double")


def test_published_statistics(scores):
    """Mean difference 7.2, t 36, d 16.0997, W 0, median difference 7."""
    t, d, w = stats.t_test(scores, "a", "b").first(), stats.cohens_d(scores, "a", "b").first(), stats.wilcoxon(scores, "a", "b").first()
    assert (t.mean_diff, round(t.t, 4), round(d.d, 4), d["size"], d.direction) == (pytest.approx(7.2), 36.0, 16.0997, "large", "a")
    assert (w.w, w.median_diff, w.n) == (0.0, 7.0, 5) and 0 < t.p < 1e-5
    assert stats.t_test(scores, "a", "b", compat=True).first().p == 1.0


@pytest.mark.parametrize(("t", "n", "p"), [(2.776445, 5, 0.05), (2.262157, 10, 0.05), (0.0, 4, 1.0), (12.7062, 2, 0.05), (1.959964, 100_000, 0.05)])
def test_student_tail(t, n, p):
    assert stats.t_two_sided(t, n) == pytest.approx(p, abs=2e-5)


def test_few_values(spark):
    few = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert stats.wilcoxon(few, "a", "b").first().w is None and stats.cohens_d(few, "a", "b").first().d == 0.0
    assert stats.bootstrap(few, "a", resamples=50).first().low is None


def test_bootstrap(scores):
    row = stats.bootstrap(scores, "a", resamples=4000).first()
    assert row["mean"] == pytest.approx(74.4) and row.se == pytest.approx(np.std(A, ddof=1) / math.sqrt(5)) and abs(row.low - 69.8) < 1.5 and abs(row.high - 79.0) < 1.5


# --- sources, sinks and streams --------------------------------------------------------------


def test_files_and_bodies(spark, tmp_path):
    raw = {"a.md": "公司名称".encode("gb18030"), "B.TXT": "﻿text".encode(), "c.json": b'{"a":  1}', "d.json": b"{bad", "e.pdf": b"%PDF", "f.bin": b"x"}
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "big.pdf").write_bytes(b"x" * 100)
    found = readers.files(spark, [f"file://{tmp_path}"], most_pdf=50)
    rows = {r.path.rsplit("/", 1)[1]: (r.body, r.parse_status) for r in readers.bodies(found).collect()}
    assert rows == {"a.md": ("公司名称", "ok"), "B.TXT": ("text", "ok"), "c.json": ('{"a":1}', "ok"), "d.json": ("{bad", "json_parse_error"), "e.pdf": ("", "pdf_text_empty")}


def test_json_csv_and_pairs(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int").count() == 2 and readers.json_lines(spark, f"file://{tmp_path}/none.jsonl", "a int").count() == 0
    (tmp_path / "y.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.json_array(spark, f"file://{tmp_path}/y.json", "a int").count() == 2
    (tmp_path / "z.csv").write_text('﻿a,b\n1,"x\ny"\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, f"file://{tmp_path}/z.csv").collect()] == [("1", "x\ny")]
    for k, names in (("pair_00001", ("report.md", "approval.md", "pair_metadata.json")), ("pair_00002", ("approval.md",))):
        (tmp_path / "p" / k).mkdir(parents=True)
        for name in names:
            (tmp_path / "p" / k / name).write_text(name)
    pairs = readers.pairs(spark, f"file://{tmp_path}/p")
    assert {r.pair_id: (r.report, r.approval) for r in pairs.collect()} == {"pair_00001": ("report.md", "approval.md"), "pair_00002": (None, "approval.md")}
    assert audit.pair_integrity(pairs).first().missing == ["missing_report", "missing_pair_metadata"]
    (tmp_path / "s.js").write_text('window.X = [{"code": "GB1", "qa_ref_count": 2, "kb_files": [{"file_name": "f", "path": "p"}]}];')
    assert readers.standards_index(spark, f"file://{tmp_path}/s.js").first().kb_files[0].path == "p"


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", "high", ["x", "y"]), ("b", "review", [])], "id string, tier string, v array<string>")
    sinks.csv(frame, f"file://{tmp_path}/c", ["id", "v", "none"])
    assert [tuple(r) for r in readers.csv(spark, f"file://{tmp_path}/c").orderBy("id").collect()] == [("a", "x;y", None), ("b", None, None)]
    views = sinks.tiers(frame, f"file://{tmp_path}/t")
    assert {k: v.count() for k, v in views.items()} == {"all": 2, "high": 1, "medium": 0, "review": 1, "verified": 1, "needs_review": 1, "rejected": 0}
    assert "| a | high |" in sinks.markdown("t", {"s": frame.select("id", "tier")}) and sinks.manifest({"f": frame}, x="1") == {"counts": {"f": 2}, "arguments": {"x": "1"}}
    stored = spark.createDataFrame([(1, 0), (2, 0)], "k int, s int")
    assert {r.k: r.s for r in sinks.updated(stored, spark.createDataFrame([(1, 7), (1, 9)], "k int, s int"), ["k"], ["s"]).collect()} == {1: 7, 2: 0}


def test_streams(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 10 as int)) as ts, id % 2 as k from range(12)")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = delivery.incoming(spark, f"file://{tmp_path}/in", rows.schema)
    delivery.delivered(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c1", lambda d: d.where("k = 1")).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6
    counts = delivery.windowed(stream, "ts", ["k"], "1 hour", "10 minutes")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = {(r.window_start, r.k, r.n) for r in delivery.windowed(rows, "ts", ["k"], "1 hour", "10 minutes").collect()}
    assert {(r.window_start, r.k, r.n) for r in spark.table("counted").collect()} == expected and sum(n for *_, n in expected) == 12
    assert delivery.by_session(rows, "ts", "k", "15 minutes", "1 hour").count() == 12


def test_config_terms_are_distinct():
    for table in (config.AUDIT_KEYWORDS, config.SUPPORT_TERMS, config.REQUIREMENTS):
        assert all(len(v) == len(set(v)) for v in table.values())


def test_self_evidence_and_lineage(spark, tmp_path):
    rows = spark.createDataFrame([("甲辰五金有限公司", "甲辰五金有限公司 证据原文", "甲辰五金有限公司 隔油", "证据原文", ["隔油"]), ("乙", "", "", "x", ["y"])], "company string, report string, approval string, evidence string, terms array<string>")
    assert [(r.company_found, r.evidence_found, r.terms_found) for r in audit.self_evidence(rows).collect()] == [(True, True, True), (False, False, False)]
    rows.write.parquet(f"file://{tmp_path}/clean_pairs/x")
    held = spark.read.parquet(f"file://{tmp_path}/clean_pairs/x")
    assert audit.foreign_inputs(held, ["clean_pairs"]) == [] and audit.foreign_inputs(held, ["other"])


def test_recheck_and_tallies_of_nothing(spark):
    high = "qa_id string, pair_id string, element string, task_domain string, answer string, answer_terms array<string>, codes array<string>, approval_evidence array<string>, report_evidence array<string>, blob string, report string, approval string"
    assert audit.recheck_high(spark.createDataFrame([], high)).count() == 0
    errors = "sample_id int, task_level string, element string, industry_code string, error_types array<string>"
    assert aggregate.error_tallies(spark.createDataFrame([], errors)).count() == 0
    blank = segment.theory_index(spark.createDataFrame([("a.md", " \n\t\n")], "path string, body string"))
    assert blank.count() == 0  # a file without lines is a file: no placeholder


def test_tallies_count_a_sample_once(spark):
    rows = [(1, "L1", "a", "x", ["ERR_HAL", "ERR_HAL"]), (1, "L1", "a", "x", ["ERR_HAL"]), (2, "L1", "b", None, []), (3, "L2", "b", "x", ["ERR_HAL", "ERR_PAIR"])]
    found = aggregate.error_tallies(spark.createDataFrame(rows, "sample_id int, task_level string, element string, industry_code string, error_types array<string>"))
    got = {(r.axis, r.value): (r.n_errors, r.n_samples, r.n_judged, r.systemic) for r in found.collect()}
    assert got["error_type", "ERR_HAL"] == (3, 2, None, True) and got["severity", "CRITICAL"] == (4, 2, None, False)
    assert got["task_level", "L1"] == (2, 1, 2, False) and got["industry_code", None] == (0, 0, 1, False)
    assert not any(axis in ("error_type", "severity") and value is None for axis, value in got)


# --- libraries of rules ---------------------------------------------------------------------

RULE_ROWS = "qa int, industry_code string, element string, project_type string, project_id string, level string, standards array<string>, answer string"


def test_library_on_edge_rows(spark):
    for version in (1, 2):
        assert rules.library(spark.createDataFrame([], RULE_ROWS), "qa", version).count() == 0
    rows = [(1, None, None, None, None, None, None, None), (2, None, None, None, "", "C", [], ""), (3, "C1", "废水", "新建", "p", "A", ["GB8978-1996"], "长" * 50_000)]
    found = {r.industry_code: r for r in rules.library(spark.createDataFrame(rows, RULE_ROWS), "qa").collect()}
    assert found["?"].support_count == 0 and found["?"].sample_counts.total == 2 and found["?"].common_standards == [] and found["?"].evidence_level == "C"
    assert found["C1"].common_approval_requirement == ["长" * 200] and found["C1"].rule_id == "RULE_C1_废水_新建"


@pytest.mark.parametrize("version", [1, 2])
def test_library_levels_and_lists(spark, version):
    rows = [(k, "C1", "噪声", "新建", f"p{k:02d}", "B", ["GB123482008", "GB8978-1996"], f"{k % 7}" + "甲" * 150) for k in range(30)]
    rows += [(100 + k, "C1", "废气", "新建", "q", "B", ["GB16297-1996"], "x") for k in range(2)]
    found = {r.element: r for r in rules.library(spark.createDataFrame(rows, RULE_ROWS), "qa", version).collect()}
    noise, air = found["噪声"], found["废气"]
    assert noise.rule_status == "strong_rule" and noise.evidence_level == "B" and noise.confidence == (0.6 if version == 2 else 0.7)
    assert noise.common_standards == (["GB12348-2008"] if version == 2 else ["GB123482008", "GB8978-1996"])
    assert [x[0] for x in noise.common_approval_requirement] == list("01234") and len(noise.source_project_ids) == 20 and noise.source_qa_ids == [f"p{k:02d}_噪声" for k in range(10)]
    assert air.evidence_level == ("C" if version == 2 else "B") and air.confidence == (0.2 if version == 2 else 0.4) and air.common_approval_requirement == []
    edges = {(r.head, r.relation, r.tail) for r in rules.library_triples(rules.library(spark.createDataFrame(rows, RULE_ROWS), "qa", version)).collect()}
    assert ("RULE_C1_噪声_新建", "SUPPORTED_BY", "p00") in edges and ("RULE_C1_废气_新建", "USES_STANDARD", "GB16297-1996") in edges


def test_experience_takes_written_pairs(spark):
    made = spark.createDataFrame([("R1", "C1", "废水", "A", 0.9)], "rule_id string, industry_code string, element string, evidence_level string, confidence double")
    written = spark.createDataFrame([("EXP_X", "C1", "strong_hint")], "experience_id string, industry_code string, automation_level string")
    found = {r.experience_id: r for r in rules.experience(made, written=written).collect()}
    assert found["EXP_R1"].automation_level == "auto_rule" and found["EXP_X"].automation_level == "strong_hint" and found["EXP_X"].rule_id is None


def test_library_codes(spark):
    said = [" GB 12348—2008\t", "GB123482008", "GB／T34911-2017", "DB44/26-2001", "DA001", "HJ/T912002", "", None]
    frame = spark.createDataFrame([(x,) for x in said], "x string").select(extract.library_code(F.col("x")).alias("c"))
    assert [r.c for r in frame.collect()] == ["GB12348-2008", "GB12348-2008", "GB/T34911-2017", "DB44/26-2001", "DA001", "HJ/T912002", "", None]
    assert [bool(r.v) for r in frame.select(extract.library_valid(F.col("c")).alias("v")).collect()] == [True, True, True, True, False, True, False, False]
