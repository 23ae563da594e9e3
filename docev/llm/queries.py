"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, common, decontam, jaccard, lines, lm, mixing, pii, ranking, repair, rules, simhash, substrings, tokens
from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    taken = (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    return mixing.plan(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), common.Stage(spark, "lm")).drop("mean")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kept = lines.dedup(pages, common.Stage(spark, "lines"))
    return kept.select(
        "page_id", F.col("ln_host").alias("host"), F.size("ln_lines").cast("long").alias("n_lines"),
        (F.size("ln_lines") - F.size("ln_kept")).cast("long").alias("n_dropped"), F.md5(F.array_join("ln_kept", "\n")).alias("kept_md5"),
    )


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(documents(spark, sf_dir).select("doc_id", "text")))
    base_failed = F.col("ql_failed").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return entries.select(
        "doc_id", F.col("ql_words").alias("n_words"), F.col("ql_word_chars").alias("word_chars"), F.col("ql_symbols").alias("n_symbols"),
        F.col("ql_dup_lines").alias("n_dup_lines"), F.col("ql_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"), (F.col("ql_kept") & ~base_failed).alias("kept"), F.col("ql_failed").alias("failed_bits"),
    )


def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = classifier.measure(documents(spark, sf_dir), common.Stage(spark, "classifier"))
    trees = classifier.train(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(measured, trees)
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= classifier.CUT).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The word tokenizer of the contract, found where its package is installed."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), common.Stage(spark, "jaccard"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokens.write(documents(spark, sf_dir), tokenizer_path(), common.Stage(spark, "tokens"))
    return tokens.read(*written, with_ids=False).drop("ids")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir), common.Stage(spark, "substrings"), with_text=False).drop("kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find(documents(spark, sf_dir), benchmark, common.Stage(spark, "decontam"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find(documents(spark, sf_dir).select("doc_id", "text"), common.Stage(spark, "simhash"))


def op12_grouped_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    group = lambda c: F.when(one, -1).otherwise(c).cast("long")
    month = 100 * F.year("shipped_at") + F.month("shipped_at")
    rows = lines_.select(
        group(F.col("vendor_id")).alias("vendor_id"), group(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"), group(F.coalesce(month, F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"), F.floor(100 * F.col("discount") + 0.5).cast("long").alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"), F.floor(100 * F.col("amount") + 0.5).cast("long").alias("amount_cents"),
    )
    pair = [("tens", "desc", "first"), ("percent", "asc", "first")]
    rest = [(c, "asc", "last") for c in ("sale_id", "line_no", "quantity", "amount_cents")]
    return ranking.ranked(rows, ["vendor_id", "part", "month"], pair, rest, 2, common.Stage(spark, "ranking")).drop("tens")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stage = spark.read.parquet(f"{sf_dir}/conversations.parquet"), common.Stage(spark, "repair")
    return repair.audits(repair.repair(repair.damaged(rows), stage), rows, stage)


_MIX_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, list_extract([3.0, 1.0, 2.0], (row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w, source_size * 2.0::double as cap,
         (sum(source_size) over ())::double * 1.5::double as total from s
), l as (
  select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w
), t as (
  select source, source_size, least(cap, max(level) over () * w) as target from l
), r as (
  select source, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate from t
)
select doc_id, size, source_size, target,
       (floor(rate)::bigint + (('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double < rate - floor(rate))::bigint) * size as taken
from d join r on d.source is not distinct from r.source
"""

def _lines_sql() -> str:
    body = "coalesce(html, '')"
    for pattern, by in ((lines.HIDDEN, "''"), (lines.BLOCK, "chr(10)"), ("<[^>]*>", "''")):
        body = f"regexp_replace({body}, '{pattern}', {by}, 'g')"
    for entity, character in lines.ENTITIES:
        body = f"replace({body}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return f"""
with p as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '{lines.HOST}', 1)) as host,
         list_filter(list_transform(regexp_split_to_array({body}, '[\\n\\r]+'), lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), lambda x: x <> '') as lines
  from pages
), t as (select host, count(*) as pages from p group by host),
d as (select host, line from (select host, unnest(list_distinct(lines)) as line from p) join t using (host) group by host, line, pages having count(*) >= {lines.LEAST} and count(*) > pages * {lines.RATIO}),
a as (select host, list(line) as dropped from d group by host),
k as (select page_id, host, lines, case when dropped is null then lines else list_filter(lines, lambda x: not list_contains(dropped, x)) end as kept from p left join a using (host))
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, md5(array_to_string(kept, chr(10))) as kept_md5 from k
"""


_RULES_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), m as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(regexp_extract_all(text, '!'))::bigint as n_exclaims,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from d
), v as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as window_text
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from d)
), twice as (
  select doc_id, i from v qualify count(*) over (partition by doc_id, window_text) > 1
), covered as (
  select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by doc_id
), e as (
  select m.*, coalesce(n, 0)::bigint as n_repeat_words from m left join covered using (doc_id)
), f as (
  select *, ((n_words < 20)::bigint + 2 * (n_repeat_words * 100 > n_words * 30)::bigint + 4 * (n_symbols * 2 > n_words)::bigint
         + 8 * (n_exclaims * 2 > n_words)::bigint + 16 * (word_chars < n_words * 2 or word_chars > n_words * 30)::bigint
         + 32 * (n_dup_lines * 2 > n_lines)::bigint)::bigint as failed_bits from e
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from f
"""


_LM_SQL = """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), t as (
  select r, len(words) as size, unnest(words) as w, unnest(range(1, len(words) + 1)) as p from d where len(words) > 0
), g as (
  select *, lag(w) over (partition by r order by p) as v, lag(w, 2) over (partition by r order by p) as u from t
), c as (
  select *, count(*) over () as total, count(*) over (partition by w) - count(*) over (partition by r, w) as c1,
         case when p > 1 then count(*) over (partition by v, w) - count(*) over (partition by r, v, w) end as c2,
         case when p > 2 then count(*) over (partition by u, v, w) - count(*) over (partition by r, u, v, w) end as c3 from g
), e as (
  select *, lag(c1) over (partition by r order by p) as b1, lag(c2) over (partition by r order by p) as b2 from c
), f as (
  select *, [1.0::double, 0.4::double, power(0.4::double, 2), power(0.4::double, 3)] as factor,
         case when c3 > 0 then 0 when c2 > 0 then (p > 2)::int when c1 > 0 then (p > 1)::int + (p > 2)::int else 1 + (p > 1)::int + (p > 2)::int end as steps from e
), s as (
  select r, steps, case when c3 > 0 then ln(factor[steps + 1] * c3 / b2) when c2 > 0 then ln(factor[steps + 1] * c2 / b1)
         when c1 > 0 then ln(factor[steps + 1] * c1 / (total - size)) else ln(factor[steps + 1] / total) end as l from f
), a as (select r, sum(steps)::bigint as n_backoff, sum(round(l * 1000000)::bigint)::bigint as score_micro from s group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_backoff, 0) as n_backoff, coalesce(score_micro, 0) as score_micro from d left join a using (r)
"""

_SUBSTRINGS_SQL = """
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), w as (
  select doc_id, i, array_to_string(words[i:i + 12], ' ') as window_text from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from d)
), r as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by window_text) as least from w) where least < doc_id
), c as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from r
), k as (
  select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
  from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from d) anti join c using (doc_id, p) group by doc_id
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""


_RANKING_SQL = """
with t as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc
), i as (
  select sale_id from (select distinct sale_id from sale_lines where sale_id is not null), t
  where xor(list_reduce(list_transform(string_split(sale_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) % 5 = 0
), l as (
  select case when i.sale_id is not null then -1 else vendor_id end as vendor_id, case when i.sale_id is not null then -1 else coalesce(item_id % 5, -1) end as part,
         case when i.sale_id is not null then -1 else coalesce(100 * year(shipped_at) + month(shipped_at), -1) end as month,
         floor(quantity / 10) as tens, floor(100 * discount + 0.5)::bigint as percent, s.sale_id, line_no, quantity, floor(100 * amount + 0.5)::bigint as amount_cents
  from sale_lines s left join i on s.sale_id = i.sale_id
), r as (
  select *, row_number() over (partition by vendor_id, part, month order by tens desc nulls first, percent asc nulls first, sale_id asc nulls last, line_no asc nulls last, quantity asc nulls last, amount_cents asc nulls last) as pos,
         count(*) over (partition by vendor_id, part, month, tens, percent) as tied from l
)
select vendor_id::bigint as vendor_id, part::bigint as part, month::bigint as month, pos, pos as place, sale_id, line_no::bigint as line_no, quantity::bigint as quantity, percent, amount_cents, tied from r where pos <= 2
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_lm_score": op2_lm_score,
        "op3_line_dedup": op3_line_dedup,
        "op4_pii_spans": op4_pii_spans,
        "op5_quality_rules": op5_quality_rules,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_token_ids": op7_token_ids,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_score": op9_quality_score,
        "op10_decontaminate": op10_decontaminate,
        "op11_simhash": op11_simhash,
        "op12_grouped_ranking": op12_grouped_ranking,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _MIX_SQL, "op2_lm_score": _LM_SQL, "op3_line_dedup": _lines_sql(), "op5_quality_rules": _RULES_SQL, "op8_substring_dedup": _SUBSTRINGS_SQL, "op12_grouped_ranking": _RANKING_SQL}
