"""Queries of the operators that keep state, rank, assign, search and estimate over whole tables of the shop and of
the corpus, with their SQL."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import pages
from ..operators import aggregate, assign, link, state, stats, tracing
from ..sources import readers
from .queries import query, table

# --- stored state ----------------------------------------------------------------------------

CLIENT_VALUES = ["source", "segment", "city", "balance"]


def client_table(spark, path: str) -> state.StateTable:
    return state.StateTable(spark, path, ["client_id"], ["seq", "change_id"], CLIENT_VALUES, flags={"overdrawn": "balance < 0"})


@query(f"""with g as (select client_id, max(row(seq, change_id)) filter (op = 'D') as gone, max(row(seq, change_id)) as last, coalesce(bool_or(balance < 0), false) as overdrawn from client_changes group by client_id)
select c.client_id, {", ".join(f"arg_max({v}, row(seq, change_id)) filter ({v} is not null and (gone is null or row(seq, change_id) > gone)) as {v}" for v in CLIENT_VALUES)}, any_value(g.overdrawn) as overdrawn
from client_changes c join g on c.client_id is not distinct from g.client_id where gone is null or last > gone group by c.client_id""")
def client_state(spark, sf_dir) -> DataFrame:
    """The clients after all changes, which arrive by month, the last one first, one of them twice."""
    changes = table(spark, sf_dir, "client_changes")
    clients = client_table(spark, f"{session.shared(spark)}/docev-clients-{uuid.uuid4().hex}")
    month = F.coalesce(F.month("valid_at"), F.lit(0))
    months = sorted((r[0] for r in changes.select(month.alias("m")).distinct().collect()), reverse=True)  # 13 at most
    for k, m in enumerate(months):
        clients.merge(changes.where(month == m), "changes", k)
    if months:
        clients.merge(changes.where(month == months[0]), "changes", 0)  # a number that is there: nothing to do
        clients.merge(changes.where(month == months[-1]))  # the same changes again: no other state
    found = clients.current()
    return changes.limit(0).select("client_id", *CLIENT_VALUES, F.lit(True).alias("overdrawn")) if found is None else found


# --- claims by an automaton ------------------------------------------------------------------

_TALK = "list_transform(generate_series(1, len(string_split(text, chr(10)))), lambda i: {'i': i, 'line': string_split(text, chr(10))[i]})"


@query(f"""with c as (select item_id as qa_id, text as claim, case when item_id % 4 > 0 then 'src' || (item_id % 20) end as project from benchmark),
p as (select *, trim(claim) as core, list_filter(regexp_split_to_array(trim(claim), '[\\s,，。；;、]'), lambda w: length(w) >= 4) as w from c),
q as (select *, case when length(core) < 4 then [] when len(w) > 0 then w else [substr(core, 1, 10)] end as pieces from p),
n as (select *, greatest(2, floor(len(pieces) * 0.6)) as need from q),
u as (select 1 as rank, 'report' as type, 'talk-' || conv_id || '-' || turn as file, case when conv_id % 3 = 0 then '' else 'src' || (conv_id % 20) end as project, unnest({_TALK}) as l from conversations
  union all select 2, 'approval', 'doc-' || doc_id, source, unnest({_TALK}) from documents union all select 3, 'historical_case', 'page-' || page_id, '', {{'i': 1, 'line': html}} from pages),
l as (select rank, type, file, project, l.i as line_start, l.line as line from u),
m as (select qa_id, n.claim, arg_min(row(type, file, line_start, md5(line)), row(rank, file, line_start)) as s from n join l on len(pieces) >= need and len(list_filter(pieces, lambda x: contains(line, x))) >= need
  and (type = 'historical_case' or l.project = '' or n.project is null or n.project = '' or contains(n.project, l.project) or contains(l.project, n.project)) group by qa_id, n.claim)
select qa_id, case when s is null then 'unsupported' when s[1] = 'historical_case' then 'indirect' else 'direct' end as support, s[1] as source_type, s[2] as source_file, s[3]::bigint as line_start, s[4] as quote_md5 from n left join m using (qa_id, claim)""")
def claim_trace(spark, sf_dir) -> DataFrame:
    """Each benchmark item as a claim, traced to the lines of conversations, of documents and of pages."""
    docs, talk, pages, items = (table(spark, sf_dir, t) for t in ("documents", "conversations", "pages", "benchmark"))
    claims = items.select(F.col("item_id").alias("qa_id"), F.col("text").alias("claim"), F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("src"), F.col("item_id") % 20)).alias("project_id"))
    line = F.posexplode(F.split("text", "\n")).alias("i", "text")
    said = talk.select(F.lit("report").alias("source_type"), F.concat(F.lit("talk-"), "conv_id", F.lit("-"), "turn").alias("source_file"), F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("src"), F.col("conv_id") % 20)).alias("project_id"), line)
    written = docs.select(F.lit("approval").alias("source_type"), F.concat(F.lit("doc-"), "doc_id").alias("source_file"), F.col("source").alias("project_id"), line)
    web = pages.select(F.lit("historical_case").alias("source_type"), F.concat(F.lit("page-"), "page_id").alias("source_file"), F.lit("").alias("project_id"), F.lit(0).alias("i"), F.col("html").alias("text"))
    lines = said.unionByName(written).unionByName(web).withColumn("line_start", F.col("i") + 1)
    found = tracing.traced(claims, lines, {"report": 1, "approval": 2, "historical_case": 3})
    return found.select("qa_id", "support", "source_type", "source_file", F.col("line_start").cast("long").alias("line_start"), F.md5("quote").alias("quote_md5"))


# --- ranks and tests -------------------------------------------------------------------------

_CENTS = "floor(100 * amount + 0.5)::bigint"


@query(f"select sale_id, line_no, {_CENTS} as cents, rank() over (order by {_CENTS} nulls first) + (count(*) over (partition by {_CENTS}) - 1) / 2.0::double as r from sale_lines")
def line_ranks(spark, sf_dir) -> DataFrame:
    """The average rank of every line's amount among all lines."""
    lines = table(spark, sf_dir, "sale_lines").select("sale_id", "line_no", F.floor(100 * F.col("amount") + 0.5).cast("long").alias("cents"))
    return aggregate.average_ranks(lines, "cents", "r")


@query("""with d as (select vendor_id, quantity - floor(100 * discount + 0.5) as d from sale_lines where quantity is not null and discount is not null),
m as (select vendor_id, median(d)::double as median_diff, count(*) filter (d <> 0) as n from d group by vendor_id),
k as (select vendor_id, d, rank() over (partition by vendor_id order by abs(d)) + (count(*) over (partition by vendor_id, abs(d)) - 1) / 2.0::double as r from d where d <> 0),
s as (select vendor_id, sum(case when d > 0 then r else 0 end)::double as w_plus, sum(case when d < 0 then r else 0 end)::double as w_minus from k group by vendor_id),
w as (select m.*, w_plus, w_minus, case when n >= 5 then least(w_plus, w_minus) end as w, sqrt(n * (n + 1.0::double) * (2 * n + 1) / 24) as sd from m left join s on m.vendor_id is not distinct from s.vendor_id)
select vendor_id, median_diff, n, w_plus, w_minus, w, round(case when w is null then null when sd = 0 then 1 else least(1, greatest(0.005, 2 / (1 + power(abs((w - n * (n + 1) / 4.0::double) / sd), 2.5)))) end, 9) as rough_p from w""")
def wilcoxon_groups(spark, sf_dir) -> DataFrame:
    """Signed ranks of quantity against discount, by vendor, with the rough probability; the exact one is in the tests."""
    lines = table(spark, sf_dir, "sale_lines").select("vendor_id", "quantity", F.floor(100 * F.col("discount") + 0.5).alias("percent"))
    found = stats.wilcoxon(lines, "quantity", "percent", ["vendor_id"], compat=True)
    return found.select("vendor_id", "median_diff", "n", "w_plus", "w_minus", "w", F.round("p", 9).alias("rough_p"))


@query()
def amount_intervals(spark, sf_dir) -> DataFrame:
    """Bootstrap intervals of the lines' amounts by flag, over all lines."""
    return stats.bootstrap(table(spark, sf_dir, "sale_lines"), "amount", ["flag"], resamples=1000)


# --- trees -----------------------------------------------------------------------------------


@query("""with recursive t as (select client_id::varchar as code, coalesce(name, '?') as name, case when master_id <> client_id then master_id::varchar end as parent_code from clients),
down as (select code, name as path from t where parent_code is null or parent_code not in (select code from t) union all select t.code, down.path || ' < ' || t.name from down join t on t.parent_code = down.code),
up as (select code, name as path, [code] as seen, parent_code as next_code from t where code not in (select code from down)
  union all select up.code, t.name || ' < ' || up.path, list_append(seen, t.code), t.parent_code from up join t on t.code = up.next_code where not list_contains(seen, t.code))
select code, path from down union all select code, arg_max(path, len(seen)) from up group by code""")
def client_paths(spark, sf_dir) -> DataFrame:
    """Every client's names from its first master down."""
    clients = table(spark, sf_dir, "clients")
    parent = F.when(F.col("master_id") != F.col("client_id"), F.col("master_id").cast("string"))
    return link.region_paths(clients.select(F.col("client_id").cast("string").alias("code"), F.coalesce("name", F.lit("?")).alias("name"), parent.alias("parent_code")), " < ")


# --- assignment ------------------------------------------------------------------------------


def client_vendors(spark, sf_dir) -> DataFrame:
    """Clients and the vendors that they bought from, with a score by the pieces bought."""
    sales, lines = table(spark, sf_dir, "sales").select("sale_id", "client_id").distinct(), table(spark, sf_dir, "sale_lines").where("quantity > 0").select("sale_id", "vendor_id", "quantity")
    pieces = sales.join(lines, "sale_id").where("client_id is not null and vendor_id is not null").groupBy("client_id", "vendor_id").agg(F.sum("quantity").alias("n"))
    return pieces.select("client_id", "vendor_id", F.least(F.lit(100.0), 60.0 + F.col("n")).alias("score"), F.lit(40.0).alias("company")).where("score >= 80")


@query()
def vendor_clients(spark, sf_dir) -> DataFrame:
    """Clients in order of id each take the vendor that they bought most from and that is still free: clean from 90, for
    review from 80."""
    return assign.one_sided(client_vendors(spark, sf_dir), "client_id", "vendor_id", "client_id", "vendor_id", "score", "company").select("client_id", "vendor_id", "score", "pair_status")


# --- page texts ------------------------------------------------------------------------------


def as_pdf(sheets: list[list[str]]) -> bytes:
    """Pages of lines as a file of deflated streams under one tree, in a font of two-byte codes."""
    n = len(sheets)
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(n)) + b"] /Count %d >>" % n, b"<< /Type /Font /Subtype /Type0 /BaseFont /Any >>"]
    for k, lines in enumerate(sheets):
        shown = b"BT /F1 10 Tf 12 TL 40 800 Td\n" + b"\n".join(b"<%s> Tj T*" % line.encode("utf-16-be", "surrogatepass").hex().encode() for line in lines) + b"\nET"
        held = zlib.compress(shown, 1)
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(held) + held + b"\nendstream"]
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, part) for k, part in enumerate(parts)) + b"trailer << /Root 1 0 R >>\n"


SHEET = 40


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pages.parts(whole, "text"):
            lines = [(x or "").split("\n") for x in batch.column("text").to_pylist()]
            files = [as_pdf([x[k : k + SHEET] for k in range(0, len(x), SHEET)]) for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "content"])


@query(f"""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
p as (select doc_id, unnest(range(0, len(lines), {SHEET})) as k, lines from l)
select doc_id, k // {SHEET} as page, length(t) as n_chars, md5(t) as text_md5 from (select doc_id, k, trim(array_to_string(lines[k + 1:k + {SHEET}], chr(10)), chr(10)) as t from p)""")
def pdf_pages(spark, sf_dir) -> DataFrame:
    """The pages of every document, printed and read again."""
    printed = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_printed, "doc_id long, content binary")
    read = pages.page_texts(printed).select("doc_id", F.posexplode("pages").alias("page", "t"))
    return read.select("doc_id", F.col("page").cast("long").alias("page"), F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


# --- dictionaries ----------------------------------------------------------------------------


@query("select doc_id::varchar as value, toxic::varchar as label from labels where quality = 1 and doc_id is not null")
def sql_enabled(spark, sf_dir) -> DataFrame:
    return readers.enabled(table(spark, sf_dir, "labels"), "doc_id", "toxic", "quality")


@query("select doc_id, quality from labels where toxic = 0")
def sql_undeleted(spark, sf_dir) -> DataFrame:
    return readers.undeleted(table(spark, sf_dir, "labels"), "toxic").select("doc_id", "quality")
