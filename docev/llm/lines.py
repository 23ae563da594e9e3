"""Operator 3: line deduplication by site-relative frequency.

A page's text lines are counted once a page; a line's frequency is the number of its host's pages
that hold it divided by the host's pages; lines above the boilerplate ratio are dropped from every
page of that host. Counts are aggregated before they are shuffled, by (host, line hash), so a host
with a third of all pages is spread over all tasks. The lines a host drops number at most its mean
lines a page divided by the ratio, so they travel as one short array a host.

Lines are compared by 64-bit hashes within a host: a line seen on too few pages would have to share
its hash with a boilerplate line of its own host to be dropped.

Defined results: a null or empty html has no lines; a null or unparsable url has the host ''; a line
on fewer than ``least`` pages is always kept, hence every line of a host of one page; repeated rows
count as pages of their own; an empty table gives no rows. Extra columns pass through; names
beginning with ``ln_`` are the operator's own, and such extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO = 0.1
#: A line that one page alone holds is no duplicate, however few pages its host has.
LEAST = 2

# What holds no text, the tags that end a line, and the entities that stand for a character.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|aside|main|br|hr|tr|td|th|table|title|head|body|html|blockquote|pre|form)(?:\s[^>]*)?/?>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def text_lines(html: Column) -> Column:
    """The non-blank lines of a page's text, trimmed, in order."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    body = F.regexp_replace(F.regexp_replace(body, BLOCK, "\n"), "<[^>]*>", "")
    for entity, character in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(character))
    lines = F.transform(F.split(body, r"[\n\r]+"), lambda line: F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(lines, lambda line: line != "")


def boilerplate(lined: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """ln_host and ln_dropped, the hashes of the lines above the ratio, from ln_host and ln_hashes."""
    pages = lined.groupBy("ln_host").agg(F.count("*").alias("ln_pages"))
    seen = lined.select("ln_host", F.explode(F.array_distinct("ln_hashes")).alias("h"))
    frequent = seen.groupBy("ln_host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pages = pages.checkpoint()
    told = common.join_small(frequent, pages, "ln_host", pages.count())
    return told.where(F.col("n") > F.col("ln_pages") * F.lit(ratio)).groupBy("ln_host").agg(F.collect_set("h").alias("ln_dropped"))


def dedup(pages: DataFrame, stage: common.Stage, ratio: float = RATIO, least: int = LEAST, url: str = "url", html: str = "html") -> DataFrame:
    """The pages with ln_host, ln_lines (all text lines) and ln_kept (those kept)."""
    lined = common.without(pages, "ln_").withColumn("ln_host", host(F.col(url))).withColumn("ln_lines", text_lines(F.col(html))).drop(html)
    lined = stage.table("lines", lined)
    hashed = lined.select("ln_host", F.transform("ln_lines", lambda line: F.xxhash64(line)).alias("ln_hashes"))
    dropped = boilerplate(hashed, ratio, least).checkpoint()
    held = dropped.agg(F.count("*"), F.sum(F.size("ln_dropped"))).first()
    # A few hashes a host; the broadcast counts hashes too.
    joined = common.join_small(lined, dropped, "ln_host", max(held[0], (held[1] or 0) // 20))
    none = F.array().cast("array<bigint>")
    kept = F.filter("ln_lines", lambda line: ~F.array_contains(F.coalesce("ln_dropped", none), F.xxhash64(line)))
    return joined.withColumn("ln_kept", kept).drop("ln_dropped")
