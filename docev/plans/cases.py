"""Operators over rows shaped like the audited records. Every row is made from a whole document: how often
it holds some markers picks which of the domain's phrases, codes and values its record has, or its words are
replaced by what an operator looks for. Each query has SQL written from the operator's definition, over columns
that SQL derives from documents in the same way."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import extract, match, text
from ..operators import aggregate, audit, rules, segment
from .queries import query

MARKERS = ["the", "en", "on", "ion", "re", "an", "er", "la"]


class Both(NamedTuple):
    """A value as a Column over ``_base``, made when a session is there, and as SQL over ``d``."""

    column: Callable[[], Column]
    sql: str


def _quoted(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_quoted, value)) + "]::varchar[]"
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'"


_D = "d as (select *, " + ", ".join(f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)} as n{k}" for k, m in enumerate(MARKERS)) + " from (select doc_id, coalesce(text, '') as text, lang, source from documents))"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    held = lambda m: F.floor((F.length("text") - F.length(F.replace("text", F.lit(m)))) / len(m)).alias(f"n{MARKERS.index(m)}")
    return docs.select("*", *[held(m) for m in MARKERS])


def _literal(value) -> Column:
    return F.array(*[F.lit(v) for v in value]).cast("array<string>") if isinstance(value, list) else F.lit(value)


def _pick(k: int, values: Sequence) -> Both:
    """One of the values by the count of marker k."""

    def column() -> Column:
        made = [v.column() if isinstance(v, Both) else _literal(v) for v in values]
        out = F.when(F.lit(False), made[0])
        for i, v in enumerate(made):
            out = out.when(F.col(f"n{k}") % len(values) == i, v)
        return out

    return Both(column, f"case n{k} % {len(values)} " + " ".join(f"when {i} then {v.sql if isinstance(v, Both) else _quoted(v)}" for i, v in enumerate(values)) + " end")


def _listed(values: Sequence[str], cycle: int, shift: int = 0) -> Both:
    """Those of the texts whose marker's count, moved by their place, isn't a multiple of ``cycle``."""
    at = lambda i: (i + shift) % len(MARKERS)
    column = lambda: F.array_compact(F.array(*[F.when((F.col(f"n{at(i)}") + i) % cycle != 0, v) for i, v in enumerate(values)]))
    return Both(column, "list_filter([" + ", ".join(f"case when (n{at(i)} + {i}) % {cycle} <> 0 then {_quoted(v)} end" for i, v in enumerate(values)) + "], lambda x: x is not null)")


def _joined(values: Sequence[str], cycle: int, shift: int = 0, by: str = "，") -> Both:
    found = _listed(values, cycle, shift)
    return Both(lambda: F.array_join(found.column(), by), f"coalesce(array_to_string({found.sql}, '{by}'), '')")


def _replaced(pairs: Sequence[tuple[str, str]]) -> Both:
    """The document's text with words replaced, one after the other."""

    def column() -> Column:
        out = F.col("text")
        for a, b in pairs:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    sql = "text"
    for a, b in pairs:
        sql = f"replace({sql}, {_quoted(a)}, {_quoted(b)})"
    return Both(column, sql.replace("\n", "' || chr(10) || '"))


def _col(name: str) -> Both:
    return Both(lambda: F.col(name), name)


def _rows(spark: SparkSession, sf_dir: str, spec: Mapping[str, Both]) -> DataFrame:
    return _base(spark, sf_dir).select("doc_id", *[b.column().alias(name) for name, b in spec.items()])


def _rows_sql(spec: Mapping[str, Both]) -> str:
    return "(select doc_id, " + ", ".join(f"{b.sql} as {name}" for name, b in spec.items()) + " from d)"


_ELEMENT = Both(lambda: F.when(F.col("lang") == "en", "噪声").when(F.col("lang") == "fr", "废水").when(F.col("lang") == "de", "危废").otherwise("固废"), "case lang when 'en' then '噪声' when 'fr' then '废水' when 'de' then '危废' else '固废' end")
_QUOTED_LIST = lambda x: f"'[' || coalesce(array_to_string(list_transform({x}, lambda t: chr(39) || t || chr(39)), ', '), '') || ']'"

# --- texts -----------------------------------------------------------------------------------

_MARKED = {"body": _replaced([(" the ", " <details>"), (" of ", "</details> "), (" and ", " ![img](a.png) "), (" la ", "<details>x"), (" le ", "</details>")])}
_FLAT = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<details>.*?</details>', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"with {_D} select doc_id, md5({_FLAT('body')}) as flat_md5, length({_FLAT('body')}) as n from {_rows_sql(_MARKED)}")
def clean_flat(spark, sf_dir):
    flat = text.clean_text(F.col("body"))
    return _rows(spark, sf_dir, _MARKED).select("doc_id", F.md5(flat).alias("flat_md5"), F.length(flat).alias("n"))


_HEADED = {"body": Both(lambda: F.concat(F.lit("批复要求："), _replaced([("\n", " 一、")]).column()), f"'批复要求：' || {_replaced([(chr(10), ' 一、')]).sql}")}


@query(f"with {_D}, b as (select doc_id, replace(body, '批复要求：', '') as b from {_rows_sql(_HEADED)}) select doc_id, length(b) <= 700 and len(regexp_extract_all(b, '[一二三四五六七八九十]+、')) <= 1 as trimmed from b")
def trimmed_answers(spark, sf_dir):
    return _rows(spark, sf_dir, _HEADED).select("doc_id", match.trimmed(F.col("body")).alias("trimmed"))


_CLAIMED = {
    "claim": Both(lambda: F.element_at(F.split("text", "\n"), 1), "string_split(text, chr(10))[1]"),
    "body": Both(lambda: F.substr("text", F.instr(F.concat("text", F.lit("\n")), "\n") + 1), "substr(text, strpos(text || chr(10), chr(10)) + 1)"),
}


@query(f"""with {_D}, c as (select doc_id, body, trim(claim) as core, list_filter(regexp_split_to_array(trim(claim), '[\\s,，。；;、]'), lambda w: length(w) >= 4) as w from {_rows_sql(_CLAIMED)}),
p as (select *, case when len(w) > 0 then w else [core[1:10]] end as pieces from c)
select doc_id, length(core) >= 4 and len(list_filter(pieces, lambda w: contains(body, w))) >= greatest(2, floor(len(pieces) * 0.6)) as supported from p""")
def fuzzy_support(spark, sf_dir):
    """Whether a document's first line is supported by its others."""
    return _rows(spark, sf_dir, _CLAIMED).select("doc_id", match.supported(F.col("claim"), F.col("body")).alias("supported"))


_CITED = {"body": _replaced([
    (" the ", " GB12348-2008 "), (" of ", " DB44/26 "), (" and ", " HJ/T91-2002 "), (" in ", " DA001 "), (" la ", " GB14554 "), (" que ", " DB44/262001 "), (" der ", " gb123482008 GB123482008 "),
    (" und ", " G1 "), (" de ", " GB/T 3096-2008 "), (" le ", " DB442367-2022 "),
])}


@query(f"""with {_D}, m as (select doc_id, unnest(regexp_extract_all(body, '(?:\\b(?:GB/T|GB|HJ/T|HJ|DB\\d{{2}}/T|DB\\d{{2}}/?)\\s*[/]?\\s*\\d{{0,8}}\\s*[-—－]?\\s*\\d{{0,4}}\\b|\\bDA\\d+\\b|\\bG\\d+\\b)')) as raw
    from (select doc_id, regexp_replace(body, '([^\\x00-\\x7f])', 'x', 'g') as body from {_rows_sql(_CITED)})),
n as (select doc_id, regexp_replace(upper(regexp_replace(raw, '\\s+', '', 'g')), '[—－]', '-', 'g') as c from m),
f as (select doc_id, case c when 'DB44/262001' then 'DB44/26-2001' when 'GB123482008' then 'GB12348-2008' when 'GB14554' then 'GB14554-93' when 'DB44/23672022' then 'DB44/2367-2022'
    else regexp_replace(regexp_replace(c, '^(DB\\d{{2}})(\\d)', '\\1/\\2'), '^((?:GB/T|GB|HJ/T|HJ|DB\\d{{2}}/T|DB\\d{{2}}/)\\d{{1,6}})(\\d{{4}})$', '\\1-\\2') end as code from n),
g as (select doc_id, code, regexp_matches(code, '^(GB/T|GB|HJ/T|HJ|DB\\d{{2}}/T|DB\\d{{2}}/)\\d{{1,6}}-\\d{{2,4}}$') as good from f)
select doc_id, code, good, case when good then 1 else count(*) end as n from g group by doc_id, code, good""")
def mention_quality(spark, sf_dir):
    good, bad = extract.mentions(F.col("body"))
    tag = lambda xs, ok: F.transform(xs, lambda c: F.struct(c.alias("code"), F.lit(ok).alias("good")))
    rows = _rows(spark, sf_dir, _CITED).select("doc_id", F.explode(F.concat(tag(good, True), tag(bad, False))).alias("m"))
    return rows.groupBy("doc_id", "m.code", "m.good").agg(F.count("*").alias("n"))


_ELEMENT_SQL = "case " + " ".join("when " + " or ".join(f"contains(p, '{w}')" for w in words) + f" then '{e}'" for e, words in segment.config.CLAUSE_ELEMENTS.items()) + " else '其他' end"
# A mark before every digit of a number that a point follows: the last digit first, then the digit before each mark.
_NUMBERED = "regexp_replace(parts[4], '(\\d\\s*[.．、])', chr(1) || '\\1', 'g')"
for _ in range(20):
    _NUMBERED = f"regexp_replace({_NUMBERED}, '(\\d)' || chr(1), chr(1) || '\\1' || chr(1), 'g')"
_SECTIONED = {"body": _replaced([("\n", "\n一、"), (" the ", " 废水 "), (" of ", " 1. "), (" and ", "噪声GB12348-2008 "), (" in ", " 2、"), (" la ", "固体废物HJ2.2-2018 "), (" que ", " 3．"), (" und ", "危废 "), (" de ", " 2. ")])}


@query(f"""with {_D}, s as (select doc_id, regexp_split_to_array(body, '\\n[一二三四五六七八九十][、．.]') as parts from {_rows_sql(_SECTIONED)}),
i as (select doc_id, unnest(regexp_split_to_array({_NUMBERED}, chr(1) || '+')) as p from s where len(parts) >= 4),
c as (select doc_id, trim(p, ' ' || chr(10)) as p from i)
select doc_id, {_ELEMENT_SQL} as element, substr(regexp_replace(p, '\\s+', ' ', 'g'), 1, 300) as clause, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p, '[GBDBHJ][A-Z0-9/.-]*-\\d{{4}}'), lambda c: replace(c, '-', '')))), ';') as standards
from c where length(p) >= 20""")
def section_three(spark, sf_dir):
    rows = _rows(spark, sf_dir, _SECTIONED).select("doc_id", F.explode(segment.section_clauses(F.col("body"))).alias("c"))
    return rows.select("doc_id", "c.element", F.col("c.text").alias("clause"), text.joined(F.col("c.standards")).alias("standards"))


_ANSWERED = {
    "answer": _pick(0, ["", "未提供", Both(lambda: F.concat(F.lit(" {"), "text"), "' {' || text"), Both(lambda: F.concat("text", F.lit("[PLACEHOLDER]")), "text || '[PLACEHOLDER]'"), _col("text"), "无"]),
    "is_historical": _pick(1, [True, False, False]), "has_approval": _pick(2, [True, False, True]),
}


@query(f"""with {_D} select doc_id, case when answer in ('', '未提供', '无') or contains(answer, '[PLACEHOLDER]') or starts_with(trim(answer), '{{') then 'rejected' when is_historical then 'reference_case'
  when not has_approval then 'need_human_review' else 'gold_verified' end as status from {_rows_sql(_ANSWERED)}""")
def chain_placeholders(spark, sf_dir):
    rows = _rows(spark, sf_dir, _ANSWERED).withColumnRenamed("doc_id", "qa_id").withColumn("has_report", F.lit(True))
    return audit.chain(rows.select("qa_id", F.lit("direct").alias("support")), rows).select(F.col("qa_id").alias("doc_id"), "status")


# --- audits ----------------------------------------------------------------------------------

_CODES = ["GB12348-2008", "DB44/26-2001", "GB18597-2023", "GB/T3096-2008"]
_PHRASES = ["厂界噪声执行 GB12348-2008", "生活污水经化粪池预处理后排入市政污水管网", "执行 DB44/26-2001", "危险废物委托有资质单位处置", "执行 GB18597-2023", "采取隔声、减振措施", "夜间达标", "参照 GB/T3096-2008"]
_SCOPED = "case {e} when '噪声' then list_filter({x}, lambda c: starts_with(c, 'GB12348-') or starts_with(c, 'GB/T3096-')) when '危废' then list_filter({x}, lambda c: starts_with(c, 'GB18597-')) else {x} end"


def _canonical_sql(keywords: Mapping[str, Sequence[str]]) -> tuple[str, str]:
    """The terms and codes that an answer made of the phrases gives an element."""
    codes = _SCOPED.format(e="element", x=f"list_filter({_quoted(_CODES)}, lambda c: contains(answer, c))")
    terms = "case element " + " ".join(f"when '{e}' then list_filter({_quoted(list(dict.fromkeys([*ts, *config.SUPPORT_TERMS[e]])))}, lambda t: contains(answer, t))" for e, ts in keywords.items()) + " else []::varchar[] end"
    return f"list_concat({codes}, {terms})", codes


_TERMS = ["GB12348-2008", "厂界噪声", "污水", "生活污水", "水污染物", "预处理", "排入", "DB44/26-2001"]
_FIELDS = {
    "qa_id": _pick(0, [Both(lambda: F.concat("doc_id", F.lit("_"), _ELEMENT.column()), f"doc_id || '_' || {_ELEMENT.sql}"), Both(lambda: F.concat("doc_id", F.lit("_"), F.lit("废水")), "doc_id || '_废水'"), Both(lambda: F.col("doc_id").cast("string"), "doc_id::varchar")]),
    "element": _ELEMENT, "task_domain": _pick(1, [_ELEMENT, _ELEMENT, "噪声"]), "answer": _joined(_PHRASES, 3), "answer_terms": _listed(_TERMS, 3, 2), "codes": _listed(_CODES, 3, 4), "blob": _joined([*_PHRASES, "GB 18597", "GB 12348"], 4, 1),
}
_FIELD_TERMS, _FIELD_CODES = _canonical_sql(config.AUDIT_KEYWORDS)
_SQL_ISSUE = lambda check, name, why: f"case when {check} then {{'f': '{name}', 'r': {why}}} end"
_BARE = "replace(blob, ' ', '')"
_FIELD_CHECKS = [
    _SQL_ISSUE("own = '' or own <> element", "qa_id/element", "'qa_id最后要素=' || case when own = '' then '空' else own end || '，element=' || element"),
    _SQL_ISSUE("task_domain <> element", "benchmark_metadata.task_domain", "'task_domain=' || task_domain || '，element=' || element"),
    _SQL_ISSUE("answer_terms <> terms", "answer_terms", f"'answer_terms 必须只来自当前 answer 和当前 element；actual=' || {_QUOTED_LIST('answer_terms')} || '; expected=' || {_QUOTED_LIST('terms')}"),
    _SQL_ISSUE("codes <> own_codes", "standards_normalized", f"'standards_normalized 必须只保留当前 QA 要素相关标准；actual=' || {_QUOTED_LIST('codes')} || '; expected=' || {_QUOTED_LIST('own_codes')}"),
    *[_SQL_ISSUE(f"element = '噪声' and list_contains(answer_terms, '{m}')", "answer_terms", f"'噪声 QA answer_terms 不得出现 {m}'") for m in config.NOISE_FORBIDDEN_TERMS],
    *[_SQL_ISSUE(f"element = '{e}' and contains({_BARE if m.startswith('GB') else 'blob'}, '{m}')", "cross_element_marker", f"'{e} QA 不得出现 {m}'") for e, ms in config.CROSS_MARKERS.items() for m in ms],
]


@query(f"""with {_D}, r as (select *, case when contains(qa_id, '_') then regexp_extract(qa_id, '[^_]*$') else '' end as own, list_distinct_ordered as terms, own_codes from
  (select *, {_FIELD_TERMS} as list_distinct_ordered, {_FIELD_CODES} as own_codes from {_rows_sql(_FIELDS)})),
i as (select qa_id, element, unnest([{", ".join(_FIELD_CHECKS)}]) as i from r)
select qa_id, element, i.f as error_field, i.r as error_reason from i where i is not null""")
def field_markers(spark, sf_dir):
    return audit.field_issues(_rows(spark, sf_dir, _FIELDS).drop("doc_id"))


_ALIGNED = {
    "codes": _listed(["GB16297-1996", "GB31572-2015", "GB12348-2008"], 3), "answer": _joined(["废气排放执行大气污染物排放标准", "颗粒物排放限值达标", "厂界噪声", "工业企业厂界环境噪声排放标准", "无  关"], 2, 1),
    "ev": _listed(["执行GB16297-1996大气污染物排放标准的有组织废气经收集处理后通过排气筒高空排放并满足相应的浓度限值要求与总量控制要求", "昼间", "工业企业厂界环境噪声排放标准" * 4, "GB31572 的内容", "甲" * 60], 2, 3),
}


@query(f"""with {_D}, a as (select doc_id, codes, regexp_replace(answer, '\\s+', ' ', 'g') as answer, ev, array_to_string(ev, ' ') as flat from {_rows_sql(_ALIGNED)}),
t as (select *, regexp_extract_all(answer, '[一-鿿]{{4,}}(?:标准|限值|排放|噪声|废气|废水)')[1:5] as terms from a),
s as (select *, (len(list_filter(codes, lambda c: contains(flat, c[1:8]))) / greatest(len(codes), 1) * 0.4::double + len(list_filter(terms, lambda x: contains(flat, x))) / greatest(len(terms), 1) * 0.4::double
  + case when len(list_filter(ev, lambda x: length(x) > least(50, length(answer)))) > 0 then 0.2::double else 0.0::double end) * 100 as score from t)
select doc_id, case when len(ev) = 0 or answer = '' then 'no_evidence' when score >= 60 then 'high' when score >= 30 then 'medium' else 'low' end as level, round(case when len(ev) = 0 or answer = '' then 0 else score end, 6) as score from s""")
def alignment_levels(spark, sf_dir):
    level, score = audit.alignment(F.col("codes"), F.col("answer"), F.col("ev"))
    return _rows(spark, sf_dir, _ALIGNED).select("doc_id", level.alias("level"), F.round(score, 6).alias("score"))


_WORDS = ["废水", "污水", "COD", "排入", "管网"]
_SHARES = {"answer": _joined(_WORDS, 2), "report": _joined(_WORDS, 3, 2), "approval": _joined(_WORDS, 2, 5)}


@query(f"""with {_D}, t as (select *, {" , ".join("(" + " + ".join(f"contains({c}, '{w}')::int" for w in _WORDS) + f") / {len(_WORDS)} as {n}" for c, n in (("answer", "a"), ("report", "e"), ("approval", "p")))} from {_rows_sql(_SHARES)})
select doc_id, case when a >= 0.3 and e >= 0.2 and p >= 0.2 then 'high' when a >= 0.2 and p >= 0.15 then 'medium' when a >= 0.1 then 'low' else 'none' end as level,
  round(case when a >= 0.3 and e >= 0.2 and p >= 0.2 then (a + e + p) / 3 * 100 when a >= 0.2 and p >= 0.15 then (a + p) / 2 * 100 when a >= 0.1 then a * 100 else 0 end, 6) as score from t""")
def word_alignment(spark, sf_dir):
    level, score = audit.keyword_alignment(_WORDS, F.col("answer"), F.col("report"), F.col("approval"))
    return _rows(spark, sf_dir, _SHARES).select("doc_id", level.alias("level"), F.round(score, 6).alias("score"))


_RULED = {
    "support_count": Both(lambda: (F.col("n0") % 13).cast("int"), "(n0 % 13)::int"), "common_standards": _listed(["GB16297-1996", "DA001", "GB12348-2008", "DB44", "", "HJ2.2-2018", "GB1", "DB44/2367-2022"], 3, 1),
    "trigger_condition": _listed(["项目属于C2929行业", "项目属于 C2929 塑料零件及其他塑料制品制造行业"], 2, 2), "review_checkpoints": _listed(["是否识别废气", "是否一致", "说明预处理措施及效率"], 2, 4), "n_a": Both(lambda: (F.col("n1") % 6).cast("int"), "(n1 % 6)::int"),
    "element": _ELEMENT, "expected_report_content": _listed(["相关环保措施", "废气产生工序"], 2, 6), "rule_status": _pick(5, ["strong", "common", "case_observation"]),
}


@query(f"""with {_D}, r as (select *, list_filter(common_standards, lambda s: s <> '') as st from {_rows_sql(_RULED)}),
v as (select *, list_filter(st, lambda s: s in ('DA001', 'DA002', 'DA003', 'DA004', 'DA005', 'DB44', 'DB') or length(s) < 4) as garbage,
  list_filter(st, lambda s: regexp_matches(s, '^[A-Z]{{1,3}}[0-9/-]+') and s not in ('DA001', 'DA002', 'DA003') and length(s) > 4) as valid from r),
f as (select *, len(garbage) > 0 as i1, len(valid) = 0 as i2, len(list_filter(trigger_condition, lambda t: contains(t, '属于') and length(t) < 20)) > 0 and len(trigger_condition) <= 1 as i3, len(review_checkpoints) = 0 as i4,
  len(review_checkpoints) > 0 and len(list_filter(review_checkpoints, lambda c: contains(c, '是否') and length(c) < 15)) = len(review_checkpoints) as i5, n_a < 3 as i6,
  element = '噪声' and len(list_filter(valid[1:5], lambda s: contains(s, 'DB44') or contains(s, 'GB31572') or contains(s, 'GB16297'))) > 0 as i7,
  len(expected_report_content) = 0 or (len(expected_report_content) = 1 and contains(expected_report_content[1], '相关环保措施')) as i8, rule_status = 'case_observation' and support_count < 3 as i9 from v),
s as (select *, ((50 - 20 * i3::int - 15 * i5::int) + (50 - 30 * i6::int) + case when support_count >= 10 then 100 when support_count >= 5 then 85 when support_count >= 3 then 70 when support_count >= 2 then 50 else 20 end
  + (50 - 30 * i1::int - 20 * i2::int - 20 * i7::int) + (50 - 30 * i4::int - 20 * i8::int) + (50 - 40 * i9::int)) / 6 as score from f)
select doc_id, round(score, 6) as score, case when score >= 85 then 'A' when score >= 70 then 'B' when score >= 50 then 'C' else 'invalid' end as level, case when score >= 85 then 'keep' when score >= 50 then 'downgrade' else 'invalid' end as decision,
  concat_ws(';', case when support_count < 2 then 'support_count_too_low_' || support_count end, case when i1 then 'garbage_standards_' || array_to_string(garbage[1:3], ',') end, case when i2 then 'no_valid_standards' end, case when i3 then 'trigger_too_generic' end,
    case when i4 then 'no_checkpoints' end, case when i5 then 'checkpoints_too_generic' end, case when i6 then 'insufficient_A_samples_' || n_a end, case when i7 then 'noise_rule_has_wrong_standards' end, case when i8 then 'expected_content_too_generic' end,
    case when i9 then 'case_observation_passed_as_A' end) as issues from s""")
def rule_reviews(spark, sf_dir):
    found = audit.rule_review(_rows(spark, sf_dir, _RULED))
    return found.select("doc_id", F.round("review_score", 6).alias("score"), F.col("recommended_level").alias("level"), "decision", text.joined(F.col("review_issues")).alias("issues"))


_LINKED = {"company": _pick(0, ["佛山市某某五金有限公司", "甲乙丙丁有限公司", None, "ABC", "甲乙厂"]), "file": _pick(1, ["佛山市某某批复.pdf", "甲乙丙丁 批复.pdf", "", "甲乙厂.pdf"]), "present": _pick(2, [True, True, False, None])}


@query(f"""with {_D}, t as (select *, regexp_replace(coalesce(company, ''), '[^一-鿿]', '', 'g')[1:4] as name from {_rows_sql(_LINKED)})
select doc_id, concat_ws(';', case when file <> '' and not coalesce(present, false) then 'approval_file_missing' end, case when file = '' then 'no_approval_file' end, case when name <> '' and file <> '' and not contains(file, name) then 'company_approval_mismatch' end) as issues from t""")
def file_links(spark, sf_dir):
    return _rows(spark, sf_dir, _LINKED).select("doc_id", text.joined(audit.match_issues(F.col("company"), F.col("file"), F.col("present"))).alias("issues"))


_SCORED = {
    "match_issues": _listed(["no_approval_file", "company_approval_mismatch"], 3, 1), "n_approval": Both(lambda: (F.col("n0") % 5).cast("int"), "(n0 % 5)::int"), "n_report": Both(lambda: (F.col("n1") % 4).cast("int"), "(n1 % 4)::int"), "alignment_level": _pick(2, ["high", "medium", "low", "none", None]),
    "n_standards": Both(lambda: (F.col("n3") % 4).cast("int"), "(n3 % 4)::int"), "task_domain": _pick(4, ["废水", "噪声", "", None]), "answer": _joined(_PHRASES, 2, 3), "question": _pick(5, ["q", "p", None]), "original_question": _pick(6, ["q", None]), "question_rewritten": _pick(7, [True, False, None]),
}


@query(f"""with {_D}, t as (select *, len(regexp_extract_all(coalesce(answer, ''), '[一-鿿]')) < 15 as short, coalesce(not question_rewritten, false) and original_question is distinct from question as asked from {_rows_sql(_SCORED)}),
s as (select *, case when n_approval = 0 then 0 else greatest(0, 100 - 50 * (len(match_issues) > 0)::int - 40 * (n_report = 0)::int - case when alignment_level = 'none' then 40 when alignment_level = 'low' then 30 else 0 end - 20 * (n_standards = 0)::int
  - 20 * (coalesce(task_domain, '') = '')::int - 30 * short::int - 30 * asked::int) end as score from t)
select doc_id, score, case when score >= 85 and len(match_issues) = 0 and coalesce(alignment_level in ('high', 'medium'), false) and n_standards > 0 then 'verified' when score < 60 or n_approval = 0 then 'rejected' else 'needs_human_review' end as validation,
  case when n_approval = 0 then 'rejected_no_approval' else concat_ws(';', case when len(match_issues) > 0 then 'pair_mismatch' end, case when n_report = 0 then 'no_report_evidence' end, case when alignment_level in ('low', 'none') then 'evidence_alignment_' || alignment_level end,
  case when n_standards = 0 then 'no_standards' end, case when coalesce(task_domain, '') = '' then 'no_benchmark_metadata' end, case when short then 'answer_too_short' end, case when asked then 'question_element_mismatch' end) end as issues from s""")
def rescored_rows(spark, sf_dir):
    found = audit.rescored(_rows(spark, sf_dir, _SCORED))
    return found.select("doc_id", F.col("corrected_quality_score").alias("score"), F.col("corrected_validation").alias("validation"), text.joined(F.col("corrected_quality_issues")).alias("issues"))


_CHECKED = {
    "company": _pick(0, ["佛山市顺德某某五金有限公司", "佛山市顺德某某五金有限公司", "某某厂", "ABC", ""]), "approval_file": _pick(1, ["佛山市顺德某某批复.pdf", "甲佛山市顺德某某.pdf", "某某厂.pdf", None]), "approval_source": _pick(2, ["佛山市顺德某某.pdf", "某某厂", "", None]),
    "question": _pick(3, ["q", "关于佛山市南海另一家有限公司的批复"]), "original_question": _pick(4, [None, "佛山市顺德某某五金有限公司的废水", ""]), "answer": _joined(["执行GB12348-2008标准", "排入某某污水厂", "厂界环境噪声排放标准", "参照HJ2.2-2018"], 2, 1),
    "approval_texts": _listed(["执行GB12348-2008", "排入另外河流", "厂界环境噪声排放标准"], 2, 2), "report_texts": _listed(["GB12348-2008", "排入别处管网", "无", "厂界环境噪声排放标准"], 2, 5), "codes": _listed(["GB12348-2008", "DA001", " HJ ", "GB18597-2023", "GB1", "GB31572-2015修改单说明文字"], 3, 3),
    "alignment_level": _pick(5, ["high", "low", None]), "score": _pick(6, [100, 90]), "quality_issues": _listed(["Company differs", "mismatch", "other"], 5, 6),
}
_CJK = lambda x: f"regexp_replace({x}, '[^一-鿿]', '', 'g')[1:6]"


@query(f"""with {_D}, b as (select *, {_CJK("coalesce(company, '')")} as name, coalesce(approval_file, '') as file, coalesce(approval_source, '') as src, coalesce(answer, '') as ans, coalesce(array_to_string(approval_texts, ' '), '') as ap, coalesce(array_to_string(report_texts, ' '), '') as rp,
  coalesce(nullif(original_question, ''), question, '') as q, coalesce(alignment_level = 'high', false) as high, list_filter(list_transform(codes, lambda c: trim(c)), lambda c: length(c) >= 5 and not list_contains({_quoted(config.CHECK_GARBAGE)}, c)) as sound from {_rows_sql(_CHECKED)}),
t as (select *, list_concat(regexp_extract_all(ans, '[A-Z]{{1,3}}[0-9/-]+[0-9-]*')[1:3], regexp_extract_all(ans, '[一-鿿]{{4,}}(?:标准|排放|限值|执行|废[水气]|噪声)')[1:3]) as terms, name <> '' and contains(file, name) as in_file, name <> '' and contains(src, name) as in_src,
  {_CJK("file")} as f6, {_CJK("src")} as s6, list_transform(regexp_extract_all(q, '(?:关于|佛山市?\\S{{2,15}}(?:有限公司|厂|经营部|公司))'), lambda x: {_CJK("x")}) as asked,
  regexp_extract(ans, '(排入\\S{{2,10}}(?:污水厂|处理厂|管网|水体|河流|海域))')[1:8] as r1, regexp_extract(rp, '(排入\\S{{2,10}}(?:污水厂|处理厂|管网|水体|河流|海域))')[1:8] as r2,
  list_filter(sound, lambda s: contains(ans, s) or contains(ap, s[1:10]) or contains(rp, s[1:10])) as backed from b),
i as (select *, list_concat(list_filter([case when not (in_file or in_src) then 'c1_company_not_in_approval_source' end, case when in_file and in_src and f6 <> '' and s6 <> '' and f6 <> s6 then 'c2_approval_source_mismatch' end,
  case when len(list_filter(asked, lambda x: x <> name and length(x) >= 4)) > 0 then 'c3_question_company_mismatch' end, case when len(list_filter(quality_issues, lambda x: contains(lower(x), 'company') or contains(lower(x), 'mismatch'))) > 0 then 'c4_company_mismatch_flagged' end,
  case when high and len(list_filter(terms, lambda x: contains(ap, x))) = 0 then 'c5_high_ae_no_key_terms' end, case when high and len(list_filter(terms, lambda x: contains(rp, x))) = 0 then 'c5_high_ev_no_key_terms' end, case when r1 <> '' and r2 <> '' and r1 <> r2 then 'c6_discharge_mismatch' end],
  lambda x: x is not null), list_transform(list_filter(sound, lambda s: not list_contains(backed, s)), lambda s: 'c7_std_not_in_answer_' || s[1:15])) as found from t)
select doc_id, case when len(found) > 0 then 'demoted' else 'verified' end as check_result, coalesce(array_to_string(case when score = 100 and len(found) > 0 then list_append(found, 'c10_score_100_with_issues') else found end, ';'), '') as issues,
  coalesce(array_to_string(backed, ';'), '') as codes from i""")
def ten_point_check(spark, sf_dir):
    found = audit.ten_points(_rows(spark, sf_dir, _CHECKED))
    return found.select("doc_id", "check_result", text.joined(F.col("check_issues")).alias("issues"), text.joined(F.col("codes")).alias("codes"))


_BEHAVIOR = {"industry_code": _pick(3, [_col("source"), "", None]), "element": _pick(1, ["噪声", "总量", "固废", "废水", "危废", "环境管理"]), "standards": _listed(["GB1", "GB2", "GB3", "GB4", "GB5", "GB6", "GB7"], 4), "answer": _col("text")}
_BY_ELEMENT = lambda table, otherwise: "case element " + " ".join(f"when '{e}' then {_quoted(';'.join(xs) if isinstance(xs, list) else xs)}" for e, xs in table.items()) + f" else {otherwise} end"


@query(f"""with {_D} select doc_id, {_BY_ELEMENT(config.BEHAVIOR_TRIGGERS, "'项目属于' || case when coalesce(industry_code, '') = '' then '?' else industry_code end || '行业'")} as trigger,
  {_BY_ELEMENT(config.BEHAVIOR_CHECKPOINTS, "'是否满足相关环保要求'")} as checkpoints, {_BY_ELEMENT(config.BEHAVIOR_CONTENT, "'相关环保措施'")} as content,
  substr(answer, 1, 150) as requirement, coalesce(array_to_string(standards[1:5], ';'), '') as standards from {_rows_sql(_BEHAVIOR)}""")
def behavior_rules(spark, sf_dir):
    found = rules.behavior(_rows(spark, sf_dir, _BEHAVIOR)).select("doc_id", "behavior_rule.*")
    return found.select("doc_id", F.col("trigger_condition").alias("trigger"), text.joined(F.col("review_checkpoints")).alias("checkpoints"), text.joined(F.col("expected_report_content")).alias("content"), F.col("common_approval_requirement").alias("requirement"), text.joined(F.col("common_standards")).alias("standards"))


_APPROVED = Both(lambda: F.concat(_joined(_PHRASES, 4, 2).column(), F.lit("<details>x</details>")), f"({_joined(_PHRASES, 4, 2).sql} || '<details>x</details>')")
_HIGH = {
    "qa_id": _FIELDS["qa_id"], "pair_id": Both(lambda: F.col("doc_id").cast("string"), "doc_id::varchar"), "element": _pick(2, [_ELEMENT, _ELEMENT, _ELEMENT, None]), "task_domain": _FIELDS["task_domain"], "answer": _joined(_PHRASES, 3, 1),
    "answer_terms": _listed(_TERMS, 2, 2), "codes": _listed([*_CODES, ""], 2, 4), "approval_evidence": _listed([_PHRASES[0], _PHRASES[1], " ", "甲" * 130, "夜间  达标"], 2, 3), "report_evidence": _listed(_PHRASES[3:6], 2, 1),
    "blob": _joined([*_PHRASES, "DB44/ 26-2001", "qa_v3", "GB 18597", "环境 噪声"], 6), "report": _joined(_PHRASES, 4, 5), "approval": _pick(6, [_APPROVED, _APPROVED, None]),
}
_HIGH_TERMS, _HIGH_CODES = _canonical_sql(config.ELEMENT_KEYWORDS)
_KIND = lambda check, name, why: f"case when {check} then {{'k': '{name}', 'd': {why}}} end"
_LOST = lambda evidence, body, kind: f"list_transform(list_filter(list_transform({evidence}, lambda t: {_FLAT('t')}), lambda t: not (t <> '' and contains({body}, t))), lambda t: {{'k': '{kind}', 'd': t[1:120]}})"
_ALWAYS = [_KIND("own <> element", "qa_id_element_mismatch", "'qa_id_element=' || own"), _KIND("task_domain <> element", "task_domain_element_mismatch", "'task_domain=' || task_domain"), _KIND("not known", "unknown_element", "element")]
_DEEPER = [
    _KIND("answer_terms <> terms", "answer_terms_not_current_answer_element", f"'actual=' || {_QUOTED_LIST('answer_terms')} || '; expected=' || {_QUOTED_LIST('terms')}"),
    _KIND("codes <> own_codes", "standards_not_current_answer_element", f"'actual=' || {_QUOTED_LIST('codes')} || '; expected=' || {_QUOTED_LIST('own_codes')}"),
    *[_KIND(f"element = '{e}' and (" + " or ".join(f"contains(flat, '{m}')" for m in ms) + ")", kind, "''") for e, (kind, ms) in config.RECHECK_MARKERS.items()],
    _KIND(" or ".join(f"contains(blob, '{m}')" for m in config.OLD_TABLES), "references_old_qa_dataset", "'qa_v3/qa_v4 reference found'"),
]


@query(f"""with {_D}, e as (select * replace (coalesce(element, '') as element, list_filter(codes, lambda c: c <> '') as codes) from {_rows_sql(_HIGH)}),
r as (select *, case when contains(qa_id, '_') then regexp_extract(qa_id, '[^_]*$') else '' end as own, list_contains({_quoted(list(config.ELEMENT_KEYWORDS))}, element) as known, replace(blob, ' ', '') as flat, {_HIGH_TERMS} as terms, {_HIGH_CODES} as own_codes,
  {_FLAT("coalesce(approval, '')")} as ap, {_FLAT("coalesce(report, '')")} as rp from e),
i as (select qa_id, pair_id, element, unnest(list_concat([{", ".join(_ALWAYS)}], case when known then list_concat([{", ".join(_DEEPER)}], {_LOST("approval_evidence", "ap", "approval_evidence_not_found")}, {_LOST("report_evidence", "rp", "report_evidence_not_found")}) end)) as i from r)
select qa_id, pair_id, i.k as error_type, i.d as detail from i where i is not null""")
def high_recheck(spark, sf_dir):
    return audit.recheck_high(_rows(spark, sf_dir, _HIGH)).select("qa_id", "pair_id", "error_type", "detail")


# --- theory, errors and rules ----------------------------------------------------------------

_HELD = {"processes": config.THEORY_PROCESSES, "pollutants": config.THEORY_POLLUTANTS, "measures": config.THEORY_MEASURES}
_FILES = {
    "path": Both(lambda: F.concat(F.lit("theory/"), "doc_id", F.lit(".v1.md")), "'theory/' || doc_id || '.v1.md'"),
    "body": _replaced([("\nE", "\n# E"), ("\nT", "\n#### T"), ("\nO", "\n##  O "), (" the ", " VOCs "), (" of ", " 注塑 "), (" and ", "活性炭吸附"), (" in ", "旧标准"), (" la ", " 集气罩收集 "), (" que ", "COD与氨氮"), (" und ", " 待定 "), (" de ", "甲苯")]),
}


def _sql_held(terms: Sequence[str]) -> str:
    return f"array_to_string(list_filter({_quoted(list(terms))}, lambda t: contains(s, t)), ';')"


_SQL_ALIASES = "concat_ws(';', " + ", ".join(f"case when contains(s, '{k}') then '{';'.join(v)}' end" for k, v in config.THEORY_ALIASES.items()) + ")"
_SQL_RISKS = "concat_ws(';', " + ", ".join(f"case when regexp_matches(s, '{p}')" + (f" and not regexp_matches(s, '{e}')" if e else "") + f" then '{w}' end" for p, e, w in config.RISKS) + ")"


@query(f"""with {_D}, l as (select path, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) - 1 as i from {_rows_sql(_FILES)}),
t as (select path, i, trim(line, ' ' || chr(9) || chr(13)) as s from l),
c as (select *, last_value(case when regexp_matches(s, '^#{{1,3}}\\s+') then regexp_replace(s, '^#+\\s*', '') end ignore nulls) over (partition by path order by i) as concept from t)
select regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '') || '_' || lpad(i::varchar, 4, '0') as theory_id, coalesce(concept, '') as concept, substr(s, 1, 300) as definition, path as source_file, i::int as line_end, 'llm_generated_unchecked' as review_status,
  {_SQL_ALIASES} as aliases, {', '.join(f'{_sql_held(terms)} as {name}' for name, terms in _HELD.items())}, {_SQL_RISKS} as warnings, false as supports from c where s <> ''""")
def theory_lines(spark, sf_dir):
    return _theory(segment.theory_index(_rows(spark, sf_dir, _FILES)))


def _theory(index: DataFrame) -> DataFrame:
    listed = [text.joined(F.col(f"related_{name}")).alias(name) for name in _HELD]
    return index.select("theory_id", "concept", "definition", "source_file", "line_end", "review_status", text.joined(F.col("aliases")).alias("aliases"), *listed, text.joined(F.col("risk_warnings")).alias("warnings"), F.col("can_support_gold_answer").alias("supports"))


@query("""select 'template_placeholder' as theory_id, '（无理论数据，此为占位模板）' as concept, '请将环评理论、导则说明、技术规范解读放入 data/llm_wiki/、data/theory/ 等目录' as definition, '' as source_file, 0 as line_end, 'unknown' as review_status,
  '' as aliases, '' as processes, '' as pollutants, '' as measures, '' as warnings, false as supports where not exists (select 1 from documents where lang = 'theory')""")
def theory_missing(spark, sf_dir):
    """The index of the documents that are marked as theory, of which there are none: its placeholder."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'theory'").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    return _theory(segment.theory_index(files))


_ERRED = {
    "task_level": _pick(0, ["L1", "L2", "L3", "L4"]), "element": _pick(1, [_ELEMENT, _ELEMENT, None]), "industry_code": _col("source"),
    "error_types": _pick(2, [None, _listed(["ERR_POL", "ERR_STD", "ERR_HAL", "ERR_HAL", "ERR_IND", "ERR_X", "ERR_PAIR"], 2, 3), _listed(["ERR_NUM", "ERR_INC"], 2, 4)]),
}


@query(f"""with {_D}, s as (select doc_id as id, task_level as lvl, element, industry_code as industry, list_distinct(coalesce(error_types, [])) as e from {_rows_sql(_ERRED)}),
x as (select id, lvl, element, industry, unnest(e) as err from s),
sv as (select *, coalesce(case err {" ".join(f"when '{k}' then '{v}'" for k, v in config.ERROR_SEVERITY.items())} end, 'UNKNOWN') as severity from x),
own as (select 'error_type' as axis, err as value, count(*) as n_errors, count(distinct id) as n_samples from x group by err union all select 'severity', severity, count(*), count(distinct id) from sv group by severity),
by_sample as ({" union all ".join(f"select '{axis}' as axis, {c} as value, sum(len(e))::bigint as n_errors, count(*) filter (len(e) > 0) as n_samples, count(*) as n_judged from s group by {c}" for axis, c in (("task_level", "lvl"), ("element", "element"), ("industry_code", "industry")))}),
a as (select axis, value, n_errors, n_samples, null::bigint as n_judged from own union all select * from by_sample)
select axis, value, n_errors, round(n_errors / (select count(*) from x), 9) as share, n_samples, n_judged, round(n_samples / n_judged, 9) as rate, axis = 'error_type' and n_samples > 1 as systemic from a""")
def error_taxonomy(spark, sf_dir):
    rows = _rows(spark, sf_dir, _ERRED).withColumnRenamed("doc_id", "sample_id")
    return aggregate.error_tallies(rows).withColumn("share", F.round("share", 9)).withColumn("rate", F.round("rate", 9))


_LIBRARY = {
    "industry_code": _pick(7, [_col("source"), _col("source"), _col("source"), None]), "element": _pick(1, ["废水", "噪声", "生态", "总量", "危废"]), "project_type": _pick(2, ["新建", "改扩建", "搬迁扩建"]), "level": _pick(3, ["A", "B", "B", "C"]),
    "standards": _pick(4, [None, _listed(["GB89781996", "DB44/26-2001", " GB 12348—2008", "GB8978-1996", "DA001", "", "GB／T34911-2017", "总量"], 2, 1), _listed(["GB185972001", "GB18597-2023", "HJ2025-2012", "GB3096-2008", "HJ/T 91-2002"], 3, 2)]),
    "answer": _pick(5, [_col("text"), _col("text"), _col("text"), None]), "project_id": _pick(6, [Both(lambda: F.concat(F.lit("p"), F.col("n0") % 9), "'p' || (n0 % 9)"), ""]),
}


def _library_sql(version: int) -> str:
    new = version == 2
    code = "regexp_replace(translate(trim(c, chr(9) || chr(10) || ' 　'), '—－／ 　', '--/'), '^([A-Z]{1,3}[0-9]{2,6})([0-9]{4})$', '\\1-\\2')" if new else "c"
    fits = " ".join(f"when '{e}' then " + " or ".join(f"contains(c, '{x}')" for x in xs) for e, xs in config.ELEMENT_STANDARDS.items())
    kept = f"length(c) >= 6 and regexp_matches(c, '^(GB|HJ|DB[0-9]{{2}})') and case element {fits} else true end" if new else "c <> ''"
    prefix, longer, cut = (100, 30, 200) if new else (120, 20, 120)
    checks, content = ("case element " + " ".join(f"when '{e}' then {_quoted(';'.join(xs))}" for e, xs in t[version - 1].items()) + f" else '{other}' end" for t, other in ((config.LIBRARY_CHECKPOINTS, "满足相关环保要求"), (config.LIBRARY_CONTENT, "相关环保措施")))
    more = " ".join(f"when '{e}' then ';{x}'" for e, x in config.LIBRARY_TRIGGERS[version - 1].items())
    sure = "case when a >= 3 then least(1.0, n / 5) else least(0.6, n / 5) end" if new else "case when a >= 3 then least(1.0, a / 5) when b >= 2 then least(0.7, b / 5) when total >= 2 then 0.3 else 0.1 end"
    few, poor = ("，不能作为行业稳定规律", "证据等级为C，未通过原文证据审计") if new else ("", "证据等级为C级，未通过原文证据审计")
    return f"""with {_D}, r as (select coalesce(industry_code, '?') as industry, element, project_type as kind, level as lvl, standards as codes, coalesce(answer, '') as answer, doc_id as id, project_id as project from {_rows_sql(_LIBRARY)}),
g as (select industry, element, kind, count(*) filter (lvl = 'A') as a, count(*) filter (lvl = 'B') as b, count(*) filter (lvl = 'C') as c, count(*) as total, count(distinct nullif(project, '')) as n from r group by all),
s as (select distinct industry, element, kind, {code} as c from (select *, unnest(codes) as c from r)),
st as (select industry, element, kind, string_agg(c, ';' order by c) as standards from (select * from s where {kept} qualify row_number() over (partition by industry, element, kind order by c) <= 10) group by all),
q as (select *, row_number() over (partition by industry, element, kind order by lvl, id) as i from r), qs as (select industry, element, kind, string_agg(project || '_' || element, ';' order by i) as qa from q where i <= 10 group by all),
w as (select * from q where length(answer) > {longer} qualify row_number() over (partition by industry, element, kind, substr(answer, 1, {prefix}) order by i) = 1),
an as (select industry, element, kind, string_agg(substr(answer, 1, {cut}), ';' order by i) as answers from (select * from w qualify row_number() over (partition by industry, element, kind order by i) <= 5) group by all),
pr as (select industry, element, kind, string_agg(distinct nullif(project, ''), ';' order by nullif(project, '')) as projects from r group by all)
select 'RULE_' || industry || '_' || element || '_' || kind[1:2] as rule_id, case when n >= 5 and (a + b) * 10 >= total * 6 then 'strong_rule' when n >= 3 then 'common_rule' when n >= 2 then 'candidate_rule' else 'case_observation' end as rule_status,
  case when a >= 3 then 'A' when b >= {3 if new else 2} then 'B' else 'C' end as lvl, round(({sure})::double, 6) as confidence, a, b, c, total, n, coalesce(standards, '') as standards, qa, coalesce(answers, '') as answers, coalesce(projects, '') as projects,
  '项目属于 ' || industry || ' 行业' || case element {more} else '' end as triggers, {checks} as checkpoints, {content} as content,
  concat_ws(';', case when n < 3 then '样本数不足，仅' || n || '个项目{few}' end, case when not (a >= 3 or b >= {3 if new else 2}) then '{poor}' end, case when c > a + b then '低可信样本占比过高' end) as limits
from g left join st using (industry, element, kind) left join qs using (industry, element, kind) left join an using (industry, element, kind) left join pr using (industry, element, kind)"""


def _library(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    rows = _rows(spark, sf_dir, _LIBRARY).withColumnRenamed("doc_id", "qa")
    named = {"standards": "common_standards", "qa": "source_qa_ids", "answers": "common_approval_requirement", "projects": "source_project_ids", "triggers": "trigger_condition", "checkpoints": "review_checkpoints", "content": "expected_report_content", "limits": "limitations"}
    found = rules.library(rows, "qa", version)
    return found.select("rule_id", "rule_status", F.col("evidence_level").alias("lvl"), F.round("confidence", 6).alias("confidence"), F.col("sample_counts.A").alias("a"), F.col("sample_counts.B").alias("b"), F.col("sample_counts.C").alias("c"), "sample_counts.total", F.col("support_count").alias("n"), *[F.array_join(x, ";").alias(y) for y, x in named.items()])


@query(_library_sql(1))
def library_first(spark, sf_dir):
    return _library(spark, sf_dir, 1)


@query(_library_sql(2))
def library_second(spark, sf_dir):
    return _library(spark, sf_dir, 2)
