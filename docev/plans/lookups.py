"""Queries of lookups by name, of classification with the file's name behind it, of scores by parts, and of the
integrity of pairs and rules, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import match, text
from ..operators import aggregate, audit, lookup
from . import benchmark, cases
from .queries import ENGLISH, FRENCH, GERMAN, _sql_hits, query, table

OTHER = "[^a-zà-ÿ]"
_LAST = r"([^ ]+) *$"
_VENDORS = f"""v as (select vendor_id, lower(name) as name, regexp_replace(lower(name), '{OTHER}', '', 'g') as letters,
  case when length(regexp_extract(lower(name), '{_LAST}', 1)) >= 4 then regexp_extract(lower(name), '{_LAST}', 1) end as surname,
  case when length(regexp_replace(substr(lower(name), 1, 15), '{OTHER}', '', 'g')) >= 3 then substr(regexp_replace(substr(lower(name), 1, 15), '{OTHER}', '', 'g'), 1, 6) end as head from vendors)"""


def _vendors(spark, sf_dir) -> DataFrame:
    name, last = F.lower("name"), F.regexp_extract(F.lower("name"), _LAST, 1)
    surname = F.when(F.length(last) >= 4, last)
    return table(spark, sf_dir, "vendors").select("vendor_id", name.alias("name"), F.regexp_replace(name, OTHER, "").alias("letters"), surname.alias("surname"), lookup.company_key(name, other=OTHER).alias("head"))


def _clients(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "clients").select("client_id", F.lower("name").alias("name"), F.lower("email").alias("email"))


@query(f"""with {_VENDORS}, c as (select client_id, lower(name) as name, lower(email) as email from clients where client_id is not null),
m as (select vendor_id, client_id, case when regexp_replace(c.name, ' jr$', '') = regexp_replace(v.name, ' jr$', '') then 101 when contains(c.name, surname) then 95 when contains(email, surname) then 90 when contains(c.name, head) then 85
  when contains(email, head) then 80 else 0 end as rank from v cross join c),
b as (select vendor_id, min(row(-rank, client_id)) as m from m where rank > 0 group by vendor_id)
select v.vendor_id, m[2] as found, least(100, coalesce(-m[1], 0))::double as score from v left join b using (vendor_id)""")
def vendor_lookup(spark, sf_dir) -> DataFrame:
    """Each vendor's best client: of the same name, whose name or mail holds the surname, or the first letters."""
    junior = lambda: F.regexp_replace("name", " jr$", "")
    ways = [(F.col("surname"), F.col("name"), 95.0), (F.col("surname"), F.col("email"), 90.0), (F.col("head"), F.col("name"), 85.0), (F.col("head"), F.col("email"), 80.0)]
    found = lookup.by_ways(_vendors(spark, sf_dir), _clients(spark, sf_dir), "vendor_id", "client_id", (junior(), junior()), ways)
    return found.select("vendor_id", "found", "score")


@query(f"""with {_VENDORS}, c as (select client_id, lower(name) as name, lower(email) as email, least(greatest(length(coalesce(name, '')), 1), greatest(length(coalesce(email, '')), 1)) as n from clients where client_id is not null),
b as (select head, min(row(n, client_id)) as m from (select distinct head from v where head is not null) join c on coalesce(contains(name, head), false) or coalesce(contains(email, head), false) group by head)
select vendor_id, m[2] as found, length(head) / m[1] as score from v left join b using (head)""")
def vendor_company(spark, sf_dir) -> DataFrame:
    """Each vendor's client whose shorter name its first letters cover most of."""
    found = lookup.by_company(_vendors(spark, sf_dir), _clients(spark, sf_dir), F.col("head"), ("name", "email"), "client_id")
    return found.select("vendor_id", "found", "score")


@query(f"""with {_VENDORS}, k as (select vendor_id, case when vendor_id % 2 = 0 then surname else letters end as key from v), f as (select distinct lower(email) as email from clients where email is not null),
a as (select key, min(email) as p from (select distinct key from k) join f on contains(email, key) group by key),
b as (select key, min(email) as p from (select distinct key from k where length(key) > 6) join f on contains(email, right(key, 6)) group by key)
select vendor_id, coalesce(a.p, b.p) as found, case when a.p is not null then 'key' when b.p is not null then 'tail' else 'none' end as how from k left join a using (key) left join b using (key)""")
def vendor_files(spark, sf_dir) -> DataFrame:
    """Each vendor's first mail address that holds its surname or all its letters, or else the last six."""
    key = F.when(F.col("vendor_id") % 2 == 0, F.col("surname")).otherwise(F.col("letters"))
    return lookup.by_file_name(_vendors(spark, sf_dir), _clients(spark, sf_dir), key, "email", "email").select("vendor_id", "found", "how")


_NAMES = [(["page="], "approval"), (["#top"], "report"), (["ref"], "public_participation")]


@query(f"""with k as (select page_id, regexp_extract(coalesce(url, ''), '([^/]*)$', 1) as f, html is null as gone, {_sql_hits("html[1:500]", ENGLISH)} as a, {_sql_hits("html[1:2000]", GERMAN)} as r, {_sql_hits("lower(html)", FRENCH)} as p from pages),
n as (select *, case when contains(f, 'page=') then 'approval' when contains(f, '#top') then 'report' when contains(f, 'ref') then 'public_participation' end as named,
  case when gone then 'unknown' when a >= 2 and a > r then 'approval' when r >= 2 and r > a then 'report' when p >= 2 then 'public_participation' end as told from k)
select page_id, coalesce(told, named, 'unknown') as type, case when gone then 'unreadable' when told is not null then 'content_matched' when named is not null then 'filename_fallback' else 'no_match' end as how from n""")
def scan_kinds(spark, sf_dir) -> DataFrame:
    """The pages' types by their content, else by their address."""
    kind = match.scanned_kind(F.col("html"), F.col("url"), ENGLISH, GERMAN, FRENCH, _NAMES)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("k")).select("page_id", "k.type", "k.how")


_SCORED = {
    "question": cases.Both(lambda: F.substring("text", F.lit(1), (F.col("n0") % 45).cast("int")), "substr(text, 1, n0 % 45)"),
    "answer": cases._joined(["废水达到标准后纳管", "噪声排放达标", "危险废物委托有资质单位处置并签订合同", "设置隔声罩并定期维护设备", "活性炭每季度更换一次"], 3, 1),
    "codes": cases._listed(["GB12348-2008", "DB44/26-2001"], 2, 2), "evidence": cases._listed(["报告第三章", "", "表四"], 2, 4), "decision": cases._listed(["批复第三条", ""], 2, 5),
    "issues": cases._listed(["approval_file_missing", "company_approval_mismatch", "no_approval_file"], 2, 1), "validation": cases._pick(6, ["已验证", "参考", None]),
}
_SOME = "len(list_filter({}, lambda x: x <> '')) > 0"


@query(f"""with {cases._D}, r as {cases._rows_sql(_SCORED)},
k as (select *, {_SOME.format("evidence")} as e, {_SOME.format("decision")} as a from r)
select doc_id, e::int * 25 + a::int * 25 + (len(codes) > 0)::int * 25 + (len(issues) = 0)::int * 25 as parts,
  coalesce(array_to_string(list_filter([case when not e then 'no_report_evidence' end, case when not a then 'no_approval_evidence' end, case when len(codes) = 0 then 'no_standards' end,
    case when len(issues) > 0 then 'match_issues: ' || array_to_string(issues[1:2], ';') end], lambda x: x is not null), ','), '') as reasons,
  greatest(10, 100 - (length(question) < 30)::int * 10 - (length(answer) < 50)::int * 15 - (len(codes) = 0)::int * 20 - (not e)::int * 15 - (not contains(answer, '标准') and not contains(answer, '排放'))::int * 10) as generated,
  greatest(10, 100 - (length(question) < 15)::int * 10 - (length(answer) < 20)::int * 10 - (len(codes) = 0)::int * 20 - (len(evidence) = 0)::int * 20 - (validation is distinct from '已验证')::int * 10) as checked from k""")
def quality_parts(spark, sf_dir) -> DataFrame:
    """Three scores of the records made from documents: by four parts, as generated, and as checked."""
    c = F.col
    rows = cases._rows(spark, sf_dir, _SCORED).withColumn("p", audit.four_parts(c("evidence"), c("decision"), c("codes"), c("issues")))
    made, checked = audit.generated_quality(c("question"), c("answer"), c("codes"), c("evidence")), audit.checked_quality(c("question"), c("answer"), c("codes"), c("evidence"), c("validation"))
    return rows.select("doc_id", c("p.score").alias("parts"), F.array_join("p.reasons", ",").alias("reasons"), made["score"].alias("generated"), checked["score"].alias("checked"))


@query("""with p as (select client_id::varchar as pair_id, name, email, city, segment, source, case when balance < 0 then 'x' when balance is null then null else 'json' end as meta from clients),
d as (select pair_id, trim(coalesce(nullif(trim(email), ''), source)) as r, trim(city) as a from p where meta = 'json')
select pair_id, 'missing_or_empty_file' as error_type, 'report' as field, '' as detail from p where coalesce(name, '') = ''
union all select pair_id, 'missing_or_empty_file', 'approval', '' from p where coalesce(email, '') = ''
union all select pair_id, 'missing_or_empty_file', 'pair_metadata', '' from p where meta is null
union all select pair_id, 'metadata_parse_error', 'pair_metadata', '' from p where meta = 'x'
union all select pair_id, 'metadata_required_field_empty', f, '' from (select pair_id, unnest([{'f': 'company', 'v': name}, {'f': 'project_name', 'v': segment}, {'f': 'report_source', 'v': email}, {'f': 'approval_source', 'v': city}], recursive := true) from p where meta = 'json') where trim(coalesce(v, '')) = ''
union all select pair_id, 'duplicate_report_source', 'report_source', r from d where r in (select r from d where r <> '' group by r having count(*) > 1)
union all select pair_id, 'duplicate_approval_source', 'approval_source', a from d where a in (select a from d where a <> '' group by a having count(*) > 1)""")
def pair_faults(spark, sf_dir) -> DataFrame:
    """The clients as pair folders: those without a balance have no metadata, debtors' is no JSON."""
    c = F.col
    told = F.to_json(F.struct(c("name").alias("company"), c("segment").alias("project_name"), c("email").alias("report_source"), c("source").alias("report_file_original"), c("city").alias("approval_source")))
    meta = F.when(c("balance") < 0, F.concat(F.lit("{"), F.coalesce("name", F.lit("")))).when(c("balance").isNotNull(), told)
    pairs = table(spark, sf_dir, "clients").select(c("client_id").cast("string").alias("pair_id"), c("name").alias("report"), c("email").alias("approval"), meta.alias("pair_metadata"))
    return audit.pair_errors(pairs)


@query("""with r as (select client_id as rule_id, case when segment = 'public' then 'A' else 'B' end as level, city, master_id from clients), c as (select rule_id, unnest([rule_id, master_id]) as id from r)
select rule_id, 'source_qa_id_not_in_qa_strict_high' as error_type, 'source_qa_ids' as field, id::varchar as detail from c where not exists (select 1 from sales where sales.client_id = c.id)
union all select rule_id, 'A_rule_empty_industry_code', 'industry_code', '' from r where level = 'A' and trim(coalesce(city, '')) = ''""")
def library_faults(spark, sf_dir) -> DataFrame:
    """The clients as rules that cite themselves and their masters; the high tier are the clients with a sale."""
    c = F.col
    rules = table(spark, sf_dir, "clients").select(c("client_id").alias("rule_id"), F.when(c("segment") == "public", "A").otherwise("B").alias("level"), c("city").alias("industry_code"), F.array("client_id", "master_id").alias("source_qa_ids"))
    return audit.library_errors(rules, table(spark, sf_dir, "sales").select(c("client_id").alias("qa_id")))


@query("""select row_number() over (order by conv_id nulls first, turn nulls first, role nulls first, text nulls first) as qa_num, 'conv-' || conv_id as project_id, role as element, turn as standards,
  substr(coalesce(text, ''), 1, 100) as question, substr(coalesce(text, ''), 101, 200) as answer_preview from conversations""")
def provenance(spark, sf_dir) -> DataFrame:
    """Every turn as a row of the provenance table, numbered in order of conversations."""
    c = F.col
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = aggregate.numbered(rows, "qa_num", "%d", c("conv_id"), c("turn"), c("role"), c("text"))
    said = text.default(c("text"))
    return rows.select(c("qa_num").cast("long").alias("qa_num"), F.concat(F.lit("conv-"), "conv_id").alias("project_id"), c("role").alias("element"), c("turn").alias("standards"), F.substring(said, 1, 100).alias("question"), F.substring(said, 101, 200).alias("answer_preview"))


_QUOTE = lambda x: "'" + x.replace("'", "''") + "'"
_ASK = lambda pattern, *values: "format(" + _QUOTE(pattern.replace("%s", "{}")) + ", " + ", ".join(values) + ")"
_FIXED = lambda rows: ", ".join(f"({k}, {_QUOTE(d)}, {_QUOTE(q)})" for k, (d, q) in enumerate(rows))
_PROJECT, _INDUSTRY = f"coalesce(project_id::varchar, '{config.SAMPLE_PROJECT}')", f"coalesce(industry_code, '{config.SAMPLE_INDUSTRY}')"
_SAMPLES = f"""p as (select client_id as project_id, city as industry_code from clients), q as (select vendor_id as project_id, 'N' || nation_id as industry_code, coalesce(name, '') as title from vendors),
i as (select industry_code, row_number() over (order by industry_code) as n from (select distinct industry_code from p where industry_code <> '')),
r as (select city as industry_code, coalesce(segment, '') as check_point, row_number() over (partition by city order by change_id nulls first, segment nulls first) as n from client_changes where city in (select industry_code from i where n <= 5)),
s as (select industry_code, substr(string_agg(check_point, '; ' order by n), 1, 500) as told from r where n <= 5 group by industry_code),
f as (select row_number() over (order by project_id nulls first, {_INDUSTRY}) - 1 as j, * from p qualify j < 3),
u as (
  select 0 as kind, 'extraction' as question_type, 'simple' as difficulty, d as task_domain, {_ASK(config.EXTRACTION_QUESTION, "d", _PROJECT)} as question, {_PROJECT} as source_project_id, {_INDUSTRY} as industry_code, project_id as o0, {_INDUSTRY} as o1, j::varchar as o2
  from p, (values {", ".join(f"({k}, '{d}')" for k, d in enumerate(config.EXTRACTION_DOMAINS))}) t(j, d)
  union all select 1, 'matching', 'medium', '报告-批复对应', {_ASK(config.MATCHING_QUESTION, "substr(title, 1, 80)", "substr(title, 1, 80)")}, {_PROJECT}, {_INDUSTRY}, project_id, title, title from q
  union all select 2, 'knowledge', 'simple', '标准引用', {_ASK(config.KNOWLEDGE_QUESTION, "industry_code")}, '{config.SAMPLE_PROJECT}', industry_code, 0, industry_code, '' from i where n <= 10
  union all select 3, 'reasoning', 'hard', '行业经验归纳', {_ASK(config.REASONING_QUESTION, "industry_code", "told")}, '{config.SAMPLE_PROJECT}', industry_code, 0, industry_code, '' from s
  union all select 4, 'evaluation', 'hard', d, {_ASK(config.EVALUATION_QUESTION, "x")}, '{config.SAMPLE_PROJECT}', '{config.SAMPLE_INDUSTRY}', j, '', '' from (values {_FIXED(config.EVALUATION_SCENARIOS)}) t(j, d, x)
  union all select 5, 'calculation', 'medium', d, x, {_PROJECT}, {_INDUSTRY}, j, '', '' from (values {_FIXED(config.CALCULATIONS)}) t(j, d, x) left join f using (j)),
k as (select *, row_number() over (order by kind, o0 nulls first, o1 nulls first, o2 nulls first) as seq from u)"""


def _built(spark, sf_dir) -> dict[str, DataFrame]:
    c = F.col
    projects = table(spark, sf_dir, "clients").select(c("client_id").alias("project_id"), c("city").alias("industry_code"))
    title = F.coalesce("name", F.lit(""))
    pairs = table(spark, sf_dir, "vendors").select(c("vendor_id").alias("project_id"), F.concat(F.lit("N"), "nation_id").alias("industry_code"), title.alias("approval_title"), title.alias("report_name"))
    rules = table(spark, sf_dir, "client_changes").select(c("city").alias("industry_code"), c("change_id").alias("rule_id"), c("segment").alias("check_point"))
    return benchmark.build(projects, pairs, rules)


@query(f"with {_SAMPLES} select 'SAMPLE_' || industry_code || '_' || upper(question_type) || '_' || case when seq < 1000 then lpad(seq::varchar, 3, '0') else seq::varchar end as sample_id, seq, question_type, difficulty, task_domain, source_project_id, question from k")
def benchmark_samples(spark, sf_dir) -> DataFrame:
    """Samples of all six kinds: clients are projects, vendors pairs, and changes of clients rules of their city."""
    return _built(spark, sf_dir)["samples"].select("sample_id", "seq", "question_type", "difficulty", "task_domain", "source_project_id", "question")


@query(f"with {_SAMPLES} " + " union all ".join(f"select '{name}' as field, {name} as value, count(*) as n from k group by {name}" for name in benchmark.COUNTED) + " union all select 'total', '', count(*) from k")
def benchmark_statistics(spark, sf_dir) -> DataFrame:
    return _built(spark, sf_dir)["statistics"]
