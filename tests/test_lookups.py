"""Lookups by containment, guesses from names, scores by parts and faults of pairs, against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from docev.functions import fuzzy, match
from docev.operators import audit, lookup
from docev.sources import readers
from tests.test_explain import plan

C = F.col


def drawn(draw, letters, low, high):
    return "".join(draw.choices(letters, k=draw.randint(low, high)))


def test_first_holders_are_those_of_a_nested_loop(spark):
    draw = random.Random(1)
    texts = [(drawn(draw, "ab甲", 0, 12), draw.randint(0, 3), k) for k in range(400)] + [(None, 0, 900), ("ab", None, 901), ("ab", 0, None), ("b" * 20_000 + "zz", 5, 902)]
    keys = [drawn(draw, "ab甲", 0, 5) for _ in range(120)] + [None, "", "zz", "none"]
    held = spark.createDataFrame(texts, "x string, measure long, place long").repartition(4)
    found = {r.key: (r.measure, r.place) for r in lookup.first_holders(spark.createDataFrame([(k,) for k in keys], "key string"), held, block_rows=25).collect()}
    good = [t for t in texts if t[0] and t[1] is not None and t[2] is not None]
    expected = {k: min((m, p) for x, m, p in good if k in x) for k in set(keys) if k and any(k in x for x, _, _ in good)}
    assert found == expected and "none" not in found
    assert lookup.first_holders(spark.createDataFrame([(None,)], "key string"), held).count() == 0
    assert lookup.first_holders(spark.createDataFrame([("a",)], "key string"), held.limit(0)).count() == 0


def test_a_common_key_leaves_one_row_a_task(spark):
    held = spark.range(20_000).select(F.lit("boilerplate").alias("x"), F.lit(0).alias("measure"), C("id").alias("place"))
    frame = lookup.first_holders(spark.createDataFrame([("boiler",), ("plate",)], "key string"), held)
    assert {(r.key, r.place) for r in frame.collect()} == {("boiler", 0), ("plate", 0)}
    assert "NestedLoop" not in plan(frame) and "CartesianProduct" not in plan(frame)


def plain_ways(left, right):
    """The first file of an equal name, else the highest score, the first of equals."""
    out = {}
    for ident, base, doc_no, company in left:
        best, score = None, 0
        for place, folder, body in right:
            if folder.replace("_m", "") == base.replace("_m", ""):
                best, score = place, 100
                break
            ways = [95 if doc_no and doc_no in folder else 0, 85 if company and company in folder else 0, 0, 90 if doc_no and doc_no in body else 0, 80 if company and company in body[:20] else 0]
            near = fuzzy.partial(base[:40], folder[:40]) if base and folder else 0
            ways[2] = near if near > 75 else 0
            if max(ways) > score:
                best, score = place, max(ways)
        out[ident] = (best, pytest.approx(score))
    return out


def test_six_ways(spark):
    draw = random.Random(4)
    word = lambda low, high: drawn(draw, "abcde甲乙丙", low, high)
    right = [(k, word(3, 14) + draw.choice(["", "_m"]), word(0, 40)) for k in range(120)]
    left = [(k, draw.choice([word(3, 14), draw.choice(right)[1], draw.choice(right)[1].replace("a", "b", 1)]), draw.choice(["", word(2, 5)]), draw.choice(["", word(3, 4)])) for k in range(150)]
    a, b = spark.createDataFrame(left, "id long, base string, doc_no string, company string"), spark.createDataFrame(right, "place long, folder string, body string")
    bare = lambda x: F.replace(x, F.lit("_m"), F.lit(""))
    ways = [(C("doc_no"), C("folder"), 95.0), (C("company"), C("folder"), 85.0), (C("doc_no"), C("body"), 90.0), (C("company"), F.substring("body", 1, 20), 80.0)]
    alike = (F.substring("base", 1, 40), F.substring("folder", 1, 40), 75.0)
    found = lookup.by_ways(a, b, "id", "place", (bare(C("base")), bare(C("folder"))), ways, alike)
    expected = plain_ways(left, right)
    assert {r.id: (r.found, r.score) for r in found.collect()} == expected
    assert {round(s.expected) for _, s in expected.values()} >= {0, 80, 85, 90, 95, 100}
    empty = lookup.by_ways(a, b.limit(0), "id", "place", (C("base"), C("folder")), ways)
    assert {(r.found, r.score) for r in empty.collect()} == {(None, 0.0)} and empty.count() == len(left)


def test_partial_similarity_of_many_pairs():
    draw = random.Random(2)
    pairs = [(drawn(draw, "abc甲", 1, 12), drawn(draw, "abc甲", 1, 30)) for _ in range(3000)]
    assert fuzzy.similar_many(*map(list, zip(*pairs, strict=True)), whole=False) == pytest.approx([fuzzy.partial(a, b) for a, b in pairs])


def test_company_and_file_name(spark):
    projects = [(1, "甲乙丙丁电器扩建", "某单位"), (2, "甲乙丙丁", None), (3, None, "甲乙丙丁戊己庚"), (4, "a", "甲乙丙丁")]
    entries = [("甲乙丙丁",), ("甲 乙-丙(丁)",), ("甲乙",), (None,), ("没有的公司",), ("甲乙丙丁",)]
    found = lookup.by_company(spark.createDataFrame(entries, "company string"), spark.createDataFrame(projects, "id long, project string, unit string"), lookup.company_key(C("company")), ("project", "unit"), "id")
    # A missing name counts as one character, so project 2, 3 and 4 are covered alike: the first stays.
    assert sorted((r.company or "", r.found, r.score) for r in found.collect()) == sorted([("甲乙丙丁", 2, 4.0)] * 2 + [("甲 乙-丙(丁)", 2, 4.0), ("甲乙", None, None), ("", None, None), ("没有的公司", None, None)])
    files = spark.createDataFrame([("b 甲乙丙丁戊己.pdf",), ("a 乙丙丁戊己庚辛.pdf",), (None,)], "name string")
    rows = spark.createDataFrame([("甲乙",), ("某乙丙丁戊己庚",), ("不在的名字们哪",), ("",), (None,)], "key string")
    told = {r.key: (r.found, r.how) for r in lookup.by_file_name(rows, files, C("key"), "name", "name").collect()}
    assert told == {"甲乙": ("b 甲乙丙丁戊己.pdf", "key"), "某乙丙丁戊己庚": ("a 乙丙丁戊己庚辛.pdf", "tail"), "不在的名字们哪": (None, "none"), "": ("a 乙丙丁戊己庚辛.pdf", "key"), None: (None, "none")}


def test_scanned_kinds(spark):
    cases = [
        ("批复如下：我局同意。", "x", "approval", "content_matched"), ("a" * 500 + "批复如下：我局同意。", "/d/佛环1号.pdf", "approval", "filename_fallback"),
        ("工程分析，结论与建议", "批复", "report", "content_matched"), ("公示与听证", "", "public_participation", "content_matched"), ("佛环 环审 工程分析 结论与建议", "公示.pdf", "public_participation", "filename_fallback"),
        ("", "受理.pdf", "report", "filename_fallback"), ("公示", "批复/other.pdf", "unknown", "no_match"), (None, "批复.pdf", "unknown", "unreadable"), ("", None, "unknown", "no_match"),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, body string, path string, type string, how string")
    found = rows.select("k", "type", "how", match.scanned_kind(C("body"), C("path")).alias("s"))
    assert all((r.s.type, r.s.how) == (r.type, r.how) for r in found.collect())


def test_inventory_and_pair_flags(spark, tmp_path):
    for name in ("佛环03环审〔2024〕12号 关于甲乙公司新建项目环境影响报告表的批复.pdf", "plain.PDF", "notes.txt"):
        (tmp_path / name).write_bytes(b"x" * 52429)
    rows = {r.file_name: r for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {n for n in (p.name for p in tmp_path.iterdir()) if n.lower().endswith(".pdf")}
    told = next(r for n, r in rows.items() if n.startswith("佛环"))
    assert (told.size_mb, told.year_guess, told.company_guess, told.doc_no_guess, told.maybe_approval) == (0.05, "2024", "甲乙公司", "佛环03环审〔2024〕12号", True)
    assert (rows["plain.PDF"].year_guess, rows["plain.PDF"].company_guess, rows["plain.PDF"].maybe_approval) == ("", "", False)
    root = tmp_path / "pairs"
    for k, parts in {"pair_1": {"report.md": "r", "pair_metadata.json": json.dumps({"company": "甲", "match_score": 91.5})}, "pair_2": {"report.md": "r", "approval.md": "a"}, "pair_3": {"approval.md": "a", "pair_metadata.json": "{}"}}.items():
        (root / k).mkdir(parents=True)
        for name, body in parts.items():
            (root / k / name).write_text(body)
    flags = {r.pair_id: r for r in readers.pair_flags(readers.pairs(spark, str(root))).collect()}
    assert set(flags) == {"pair_1", "pair_3"}
    assert (flags["pair_1"].company, flags["pair_1"].match_score, flags["pair_1"].has_report, flags["pair_1"].has_approval) == ("甲", 91.5, True, False)
    assert (flags["pair_3"].match_score, flags["pair_3"].has_report, flags["pair_3"].has_approval) == (0.0, False, True)


def test_pair_and_library_errors(spark):
    whole = json.dumps({"company": "甲", "project_name": "p", "report_source": "r1", "approval_file_original": "a1"})
    other = json.dumps({"company": " ", "project_name": "p", "report_source": "r1 ", "approval_source": "a2"})
    pairs = spark.createDataFrame([("p1", "x", "y", whole), ("p2", "x", "y", other), ("p3", None, "", None), ("p4", "x", "y", "{no"), ("p5", "x", "y", "")], "pair_id string, report string, approval string, pair_metadata string")
    found = sorted((r.pair_id, r.error_type, r.field, r.detail) for r in audit.pair_errors(pairs).collect())
    missing, blank = "missing_or_empty_file", "metadata_required_field_empty"
    assert found == sorted([
        ("p1", blank, "approval_source", ""), ("p2", blank, "company", ""), ("p3", missing, "report", ""), ("p3", missing, "approval", ""), ("p3", missing, "pair_metadata", ""), ("p4", "metadata_parse_error", "pair_metadata", ""),
        ("p5", missing, "pair_metadata", ""), ("p5", "metadata_parse_error", "pair_metadata", ""), ("p1", "duplicate_report_source", "report_source", "r1"), ("p2", "duplicate_report_source", "report_source", "r1"),
    ])
    rules = spark.createDataFrame([("R1", "A", " ", ["q1", "q2"]), ("R2", "A", "C29", ["q2"]), ("R3", "B", None, None)], "rule_id string, level string, industry_code string, source_qa_ids array<string>")
    high = spark.createDataFrame([("q1",), ("q1",)], "qa_id string")
    assert sorted((r.rule_id, r.error_type, r.detail) for r in audit.library_errors(rules, high).collect()) == [
        ("R1", "A_rule_empty_industry_code", ""), ("R1", "source_qa_id_not_in_qa_strict_high", "q2"), ("R2", "source_qa_id_not_in_qa_strict_high", "q2"),
    ]
    assert audit.pair_errors(pairs.limit(0)).count() == audit.library_errors(rules.limit(0), high).count() == 0


def test_scores_by_parts(spark):
    none = "array<string>"
    rows = spark.createDataFrame([("q" * 30, "标准" * 30, ["c"], ["e"], ["a"], [], "已验证"), (None, None, None, [""], None, ["x", "y", "z"], None)], f"q string, a string, codes {none}, ev {none}, ap {none}, issues {none}, v string")
    found = rows.select(
        audit.four_parts(C("ev"), C("ap"), C("codes"), C("issues")).alias("p"), audit.generated_quality(C("q"), C("a"), C("codes"), C("ev")).alias("g"), audit.checked_quality(C("q"), C("a"), C("codes"), C("ev"), C("v")).alias("c"),
    ).collect()
    assert [(r.p.score, r.g.score, r.c.score) for r in found] == [(100, 100, 100), (0, 30, 50)]
    assert found[1].p.reasons == ["no_report_evidence", "no_approval_evidence", "no_standards", "match_issues: x;y"]
    assert found[1].g.issues == ["question too short", "answer too short", "no standards", "no evidence", "answer lacks standards reference"]
    assert found[1].c.issues == ["short question", "short answer", "no standards", "not validated"]
