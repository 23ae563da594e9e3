"""Scalar functions by their boundary values."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docev import config
from docev.functions import extract, fuzzy, match, spans, text

NOTICE = (
    "关于佛山市顺德区某某五金有限公司新建项目环境影响报告表的批复\n佛山市顺德区某某五金有限公司：\n你单位报批的《某某五金有限公司新建项目环境影响报告表》收悉。经研究，批复如下："
    "一、废水经隔油处理后排入市政污水管网，执行 DB44/26-2001。二、噪声执行 GB 12348—2008 标准。2023年3月5日 佛环顺审〔2023〕12号 VOCs≤0.5 t/a"
)


@pytest.fixture(scope="module")
def value(spark):
    global X  # noqa: PLW0603  a column needs a session
    X = F.col("x")
    one = spark.range(1)

    def get(column, x=None):
        frame = one if x is None else spark.createDataFrame([(x,)], "x string")
        return frame.select(column.alias("v")).first().v

    return get


X = None


def test_cleaning(value):
    raw = " a<details>\nhidden</details>　b ![i](u)\n\n\n\nc "
    assert value(text.clean_text(X), raw) == "a b c"
    assert value(text.clean_markdown(X), "a\n\n\n\nb") == "a\n\nb"
    assert value(text.clean_html(X), "<p>a</p>  <b>c</b>") == "a c"
    assert value(text.normalize(X), "ＡB 某-c1") == "b某c1" and value(text.cjk_only(X), "a某b物") == "某物"
    assert value(text.strip(X, config.TITLE_MARKS), "《：某某。 ") == "某某"
    assert value(text.after_last(X), "q_1_噪声") == "噪声" and value(text.after_last(X), "none") == ""
    assert value(text.listed(X), "") == [] and value(text.listed(X), "a;b") == ["a", "b"]
    assert value(text.tail(X, 2), "abc") == "bc" and value(text.default(X, "d"), "") == "d"


def test_mojibake_is_repaired_and_sound_text_stays(value):
    broken = ("废水" * 2).encode().decode("gbk")
    assert value(text.repaired(X, ["废水"], list(broken[:2])), broken) == "废水" * 2
    assert value(text.repaired(X, ["废水"], ["无"]), broken) == broken and value(text.repaired(X, ["废水"], ["废", "水"]), "废水") == "废水"


def test_decoding(value):
    body = lambda raw: value(text.decoded(F.unhex(F.lit(raw.hex()))))
    assert body("﻿某某".encode()) == "某某" and body("某某公司".encode("gb18030")) == "某某公司"


@pytest.mark.parametrize(("r", "a", "p", "kind", "confidence"), [(0, 0, 2, "public_participation", 40), (3, 0, 2, "public_participation", 40), (4, 0, 2, "report", 48), (3, 3, 0, "approval", 36), (4, 3, 0, "report", 48), (2, 2, 0, "unknown", 0), (10, 0, 0, "report", 100)])
def test_priority(value, r, a, p, kind, confidence):
    body = " ".join([f"r{k}" for k in range(r)] + [f"a{k}" for k in range(a)] + [f"p{k}" for k in range(p)])
    lists = [[f"{c}{k}" for k in range(10)] for c in "rap"]
    assert tuple(value(match.priority(X, *lists, hint="hint"), body)) == (kind, confidence)


def test_labels(value):
    labels = {"one": ["a", "b"], "two": ["b", "c"], "three": ["d"]}
    assert value(match.best_label(X, labels, "other"), "b") == "one" and value(match.best_label(X, labels, "other"), "b c") == "two" and value(match.best_label(X, labels, "other"), "x") == "other"
    assert value(match.first_label(X, labels), "c d") == "two" and value(match.all_labels(X, labels, "none"), "b d") == ["one", "two", "three"]
    assert value(match.all_labels(X, labels, "none"), "x") == ["none"]
    assert value(match.matched_labels(X, {"RP01": "water", "RP02": "air"}, [F.lit("RP02")], "RP03"), "WATER") == ["RP02", "RP01"]
    assert value(match.expanded(X, {"a": ["x", "y"], "b": ["y", "z"]}), "ab") == ["x", "y", "z"]
    assert value(match.sorted_terms(X, ["c", "a", "c"]), "abc") == ["a", "c"]


def test_support_needs_two_pieces(value):
    claim = F.lit("废水经隔油处理，排入市政管网")
    assert value(match.supported(claim, X), "废水经隔油处理后，排入市政管网") and not value(match.supported(claim, X), "废水经隔油处理")
    one = F.lit("废水经隔油处理")
    assert not value(match.supported(one, X), "废水经隔油处理") and value(match.supported(one, X, least=1), "废水经隔油处理")


def test_fields(value):
    assert value(extract.company(X), NOTICE) == "佛山市顺德区某某五金有限公司"
    assert value(extract.project_name(X), NOTICE) == "某某五金有限公司新建项目"
    assert value(extract.report_type(X), NOTICE) == "报告表" and value(extract.project_type(X), NOTICE) == "新建"
    assert value(extract.date(X), NOTICE) == "2023-03-05" and value(extract.doc_no(X), NOTICE) == "佛环顺审〔2023〕12号"
    assert value(extract.year(X, F.lit("p/2021/x")), "none") == "2021" and value(extract.date(X, F.lit("2021")), "none") == "2021"
    assert value(extract.title(X), NOTICE).startswith("关于") and value(extract.town(X), "容桂 大良") == "大良"
    assert value(extract.industry_code(X), "行业 C3311 金属") == "C3311"
    assert [tuple(v) for v in value(extract.limits(X), NOTICE + " COD: 40 mg/L")] == [("VOCs", 0.5, "t/a"), ("COD", 40.0, "mg/L")]
    assert value(extract.cap(X), "不超过 1.25 吨/年") == 1.25
    assert value(extract.first_match(X, ["a(z*)", "b(.+)"]), "a b  c ;") == "c"


@pytest.mark.parametrize(("raw", "code", "valid"), [("GB 12348—2008", "GB12348-2008", True), ("GB123482008", "GB12348-2008", True), ("gb14554-93", "GB14554-1993", True), ("GB3838-50", "GB3838-2050", True), ("GB3838-51", "GB3838-1951", True), ("DB44 26-2001", "DB44/26-2001", True), ("DB44", "DB44", False), ("DA001", "DA001", False), ("HJ/T 55-2000", "HJ/T55-2000", True)])
def test_codes(value, raw, code, valid):
    assert value(extract.normal_code(X), raw) == code and value(extract.valid_code(extract.normal_code(X)), raw) == valid


def test_code_lists(value):
    assert value(extract.codes(X), NOTICE) == ["DB44/26-2001", "GB12348-2008"]
    assert value(extract.codes(X), "执行GB12348-2008") == []  # a word boundary is wanted
    assert value(extract.element_codes(F.lit("噪声"), X), NOTICE) == ["GB12348-2008"]
    good, bad = extract.mentions(X, r"((?:GB|DB)\d+(?:-\d+)?)")
    assert value(good, "GB1-2000 GB1-2000 DB44 DB44") == ["GB1-2000"] and value(bad, "GB1-2000 DB44 DB44") == ["DB44", "DB44"]
    assert value(extract.sound_codes(F.array(F.lit("DA001"), F.lit("GB12348-2008"), F.lit("DB")))) == ["GB12348-2008"]
    assert "GB18599" not in value(extract.without_other_codes(X), "委托处置，GB18599-2020，执行")


def test_claims(value):
    patterns = {"std": ["执行[^。]+"], "water": ["废水[^。]+", "执行[^。]+"]}
    assert [tuple(c) for c in value(extract.claims(X, patterns), "执行甲乙丙丁标准。废水排入市政管网。")] == [("执行甲乙丙丁标准", "std"), ("废水排入市政管网", "water")]
    assert [tuple(c) for c in value(extract.claims(X, patterns), "短")] == [("短", "general")]


def test_spans_are_where_they_say(value):
    flat = value(text.clean_text(X), NOTICE)
    found = value(spans.evidence(X, ["噪声", "废水"], 40), flat)
    assert flat[found.char_start : found.char_end] == found.text and "废水" in found.text
    assert value(spans.evidence(X, ["没有"]), flat) is None
    best = value(spans.best_window(X, ["噪声"], F.array(F.lit("GB"), F.lit("执行")), before=20, after=30), flat)
    assert flat[best.char_start : best.char_end].strip() == best.text
    exact = value(spans.anchor_search(X, F.lit("废水经隔油处理"), F.array(F.lit("废水"))), flat)
    assert flat[exact.char_start : exact.char_end] == "废水经隔油处理" == exact.text
    near = value(spans.anchor_search(X, F.lit("没有这样的话"), F.array(F.lit("噪声"))), flat)
    assert flat[near.char_start : near.char_end] == near.text and near.char_start >= 0
    assert tuple(value(spans.anchor_search(X, F.lit("没有"), F.array().cast("array<string>")), flat)) == ("没有", -1, -1)


def test_best_window_prefers_the_leftmost_of_equals(value):
    body = "x" * 600 + "k" + "x" * 900 + "k" + "x" * 600
    assert value(spans.best_window(X, ["k"], F.array().cast("array<string>")), body).char_start == 600 - 260
    assert value(spans.best_window(X, ["k"], F.array().cast("array<string>"), excluded=["x"]), body) is None
    assert value(spans.places(X, F.lit("aa")), "aaaa.aa") == [0, 2, 5]


def test_best_window_takes_the_first_term_of_those_at_the_start(value):
    body = "k" + "x" * 24 + "mk" + "x" * 1000
    assert value(spans.best_window(X, ["m", "k"], F.array().cast("array<string>"), excluded=["none"]), body).char_end == 25 + 520
    assert value(spans.best_window(X, ["k", "m"], F.array().cast("array<string>")), body).char_end == 520


def test_focus_and_caps(value):
    body = "前" * 200 + "要点" + "后" * 300
    cut = value(spans.focus(X, ["要点"]), body)
    assert cut.startswith("...") and cut.endswith("...") and "要点" in cut and len(cut) == 286
    assert value(spans.focus(X, ["要点"]), "短句") == "短句"
    parts = F.array(*[F.lit(c * n) for c, n in (("a", 519), ("b", 5), ("c", 5))])
    assert [len(p) for p in value(spans.until(parts))] == [519, 5]
    parts = F.array(*[F.lit(c * n) for c, n in (("a", 520), ("b", 5))])
    assert [len(p) for p in value(spans.until(parts))] == [520]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_ratios():
    draw = np.random.default_rng(0)
    for _ in range(300):
        a, b = ("".join(draw.choice(list("abcd"), int(draw.integers(1, 12)))) for _ in range(2))
        assert fuzzy.common(a, b) == plain_lcs(a, b)
        short, long = sorted((a, b), key=len)
        windows = {long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))}
        assert fuzzy.partial(a, b) == max(200 * plain_lcs(short, w) / (len(short) + len(w)) for w in windows)
    assert fuzzy.similar("", "a") == 0 and fuzzy.similar("ab", "ab") == 100 and fuzzy.partial("bc", "abcd") == 100


def test_similarity_of_columns(value):
    assert value(fuzzy.similarity(F.lit("某某 五金（有限）公司"), X), "某某五金有限公司") == 100.0
    assert list(itertools.chain([value(fuzzy.similarity(F.lit(None).cast("string"), X), "a")])) == [0.0]


def test_guesses_and_risks(value):
    codes = F.array(F.lit("GB999-2020"), F.lit("GB4287-2012"))
    assert value(match.industry(codes, X, {"GB4287": "C1713"}, config.INDUSTRY_KEYWORDS), "塑料") == "C1713"
    assert value(match.industry(codes, X, {}, config.INDUSTRY_KEYWORDS), "五金塑料") == "C2929" and value(match.industry(codes, X, {}, config.INDUSTRY_KEYWORDS), "无") == "其他"
    assert value(match.outdated(X, config.OUTDATED), "执行DB44/26-2001").risk == "outdated" and value(match.outdated(X, config.OUTDATED), "").risk == "none"
    assert value(match.risks(X, config.RISKS), "VOCs 待定") == ["描述不明确需要核实", "VOCs无收集/处理措施说明"] and value(match.risks(X, config.RISKS), "VOCs 收集") == []
    assert value(match.preview(X, ["r1", "r2"], ["a1", "a2"], ["p1", "p2"]), "a1") == "approval_candidate" and value(match.preview(X, ["r1", "r2"], ["a1", "a2"], ["p1", "p2"]), "r1 r2 a1") == "report"
    assert tuple(value(match.potential(F.lit(True), F.lit(True), F.lit(10)))) == ("high", "real_error_benchmark") and value(match.potential(F.lit(False), F.lit(False), F.lit(9))).use == "experience_rule_source"


def test_ids_routes_and_contexts(value):
    assert value(extract.project_id(X), "/x/pair_00012/a.md") == "pair_00012" and value(extract.project_id(X), "/x/" + "ab" * 16) == "ab" * 16 and value(extract.project_id(X), "/x") == ""
    assert value(extract.standard_code(X), "GB 123 与 HJ 55-2000") == "HJ 55-2000" and value(extract.loose_codes(X), "GB1-2000 DB2-2001 GB1-2000") == ["DB2-2001", "GB1-2000"]
    assert value(extract.routes_differ(X, F.lit("排入乙镇污水厂")), "排入甲镇污水厂") and not value(extract.routes_differ(X, F.lit("没有")), "排入甲镇污水厂")
    told = value(text.context(F.lit("p"), X, F.lit(None).cast("string"), F.lit("s" * 3000), F.lit("")), "")
    assert told.report_text.startswith("[PLACEHOLDER: p") and told.approval_text == "" and len(told.standard_text) == 2000
    assert value(text.rewritten(X, F.lit("b")), "a").changed and not value(text.rewritten(X, F.lit("a")), "a").changed
    assert [c.claim_type for c in value(extract.claims(X, config.CLAIM_PATTERNS), "建设地点位于某某路一号。执行某某排放标准")] == ["项目基本信息", "标准依据", "标准依据"][: len(value(extract.claims(X, config.CLAIM_PATTERNS), "建设地点位于某某路一号。执行某某排放标准"))]
