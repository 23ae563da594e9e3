"""Benchmark samples against plain lists."""

from __future__ import annotations

import csv

import pytest

from docev import config
from docev.plans import benchmark
from docev.sources import sinks

PROJECTS = [("P2", "C29"), ("P1", "C33"), ("P3", None), ("P4", "C29"), ("P4", "C29")]
PAIRS = [("P2", "C29", "决定" * 60, "报告"), ("P1", "C33", None, None)]
RULES = [("C29", f"R{k}", f"point {k}") for k in range(8)] + [("C33", "R9", None), ("C99", "R1", "elsewhere")]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(PROJECTS, "project_id string, industry_code string"), spark.createDataFrame(PAIRS, "project_id string, industry_code string, approval_title string, report_name string"),
        spark.createDataFrame(RULES, "industry_code string, rule_id string, check_point string"),
    )


def listed(samples):
    return [(r.sample_id, r.question_type, r.task_domain, r.source_project_id) for r in samples.orderBy("seq").collect()]


def test_all_kinds_in_one_numbering(tables):
    samples = benchmark.candidates(*tables)
    rows = samples.orderBy("seq").collect()
    kinds = [r.question_type for r in rows]
    assert [kinds.count(k) for k in benchmark.KINDS] == [7 * len(PROJECTS), 2, 2, 2, 3, 3] and kinds == sorted(kinds, key=benchmark.KINDS.index)
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1)) and len({r.sample_id for r in rows}) == len(rows)
    assert all(r.sample_id == f"SAMPLE_{r.industry_code}_{r.question_type.upper()}_{r.seq:03d}" for r in rows)
    assert [r.source_project_id for r in rows[:35:7]] == ["P1", "P2", "P3", "P4", "P4"]
    asked = {(r.question_type, r.industry_code): r.question for r in rows}
    assert asked["reasoning", "C29"] == config.REASONING_QUESTION % ("C29", "point 0; point 1; point 2; point 3; point 4")
    assert asked["matching", "C29"] == config.MATCHING_QUESTION % (("决定" * 60)[:80], "报告") and asked["matching", "C33"] == config.MATCHING_QUESTION % ("", "")
    assert ("extraction", config.SAMPLE_INDUSTRY) in asked


def test_filters_and_counts(tables):
    built = benchmark.build(*tables, industry="C29", difficulty="hard")
    assert [r[1] for r in listed(built["samples"])] == ["reasoning", *["evaluation"] * 3]
    first = built["samples"].agg({"seq": "min"}).first()[0]
    assert first == 7 * 3 + 1 + 1 + 1  # numbers were given before the filter
    counts = {(r.field, r.value): r.n for r in built["statistics"].collect()}
    assert counts["total", ""] == 4 and counts["task_domain", "废水"] == 1 and counts["difficulty", "hard"] == 4
    one = listed(benchmark.build(*tables, task_domain="噪声")["samples"])
    assert {r[2] for r in one} == {"噪声", "报告-批复对应"} and len(one) == len(PROJECTS) + len(PAIRS)
    assert {r[1] for r in listed(benchmark.build(*tables, task_domain="总量控制")["samples"])} == {"matching"}
    assert len(listed(benchmark.build(*tables, most=4)["samples"])) == 4
    with pytest.raises(ValueError, match="no kind"):
        benchmark.candidates(*tables, kinds=["knowledge"], task_domain="噪声")


def test_no_projects(tables):
    projects, pairs, rules = (t.limit(0) for t in tables)
    rows = listed(benchmark.candidates(projects, pairs, rules))
    assert [r[1] for r in rows] == ["knowledge", *["evaluation"] * 3, *["calculation"] * 3] and {r[3] for r in rows} == {config.SAMPLE_PROJECT}


def test_review_queue(tables, tmp_path):
    samples = benchmark.candidates(*tables)
    sinks.review_queue(samples, str(tmp_path / "queue"), columns=["sample_id", "question_type"])
    found = [row for p in (tmp_path / "queue").glob("*.csv") for row in list(csv.reader(p.read_text("utf-8-sig").splitlines()))[1:]]
    assert len(found) == samples.count() and {r[1] for r in found} == set(benchmark.KINDS)
    sinks.review_queue(samples.selectExpr("sample_id", "false as need_human_review"), str(tmp_path / "none"))
    assert not [row for p in (tmp_path / "none").glob("*.csv") for row in p.read_text("utf-8-sig").splitlines()[1:]]
