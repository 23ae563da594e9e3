"""Segmentation: texts to sentences, clauses, sections and indexed lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import match, text


def sentence_array(x: Column, breaks: str = r"[\n。；;]+", least: int = 12, most: int = 900, marks: str = " ，,。；;", leads: bool = True) -> Column:
    """Sentences of a cleaned text; a break is put before mentions of the project first."""
    if leads:
        x = F.regexp_replace(x, r"(。|；|;)(?U:\s)*(项目|本项目|其|其中)", "$1\n$2")
        x = F.regexp_replace(x, r"(?U:\s)+(项目|本项目)(?=(?:生活污水|生产废水|废水|废气|VOCs|噪声|危险废物|危废))", "\n$1")
    parts = F.filter(F.split(x, breaks), lambda s: F.length(F.trim(s)).between(least, most))
    return F.transform(parts, lambda s: text.strip(s, marks))


def exploded(frame: DataFrame, array: Column, value: str, position: str = "pos") -> DataFrame:
    """One row an element, with its 0-based place."""
    return frame.select("*", F.posexplode(array).alias(position, value))


def clause_array(x: Column, least: int = 25, few: int = 3) -> Column:
    """Pieces between numbered headings; sentences if there are fewer than three."""
    parts = F.filter(F.transform(F.split(x, r"(?=[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\n\d+[.、])"), lambda s: F.trim(s)), lambda p: F.length(p) >= least)
    return F.when(F.size(parts) < few, sentence_array(x)).otherwise(parts)


def section_clauses(x: Column, elements: Mapping[str, Sequence[str]] = config.CLAUSE_ELEMENTS, section: int = 3, least: int = 20, most: int = 300, otherwise: str = "其他") -> Column:
    """Numbered items of the section that begins at the third heading of a line: array of structs
    (element, text, standards); none where a text has fewer headings. Standards lose their dashes and
    are sorted."""
    parts = F.split(x, "\n[一二三四五六七八九十][、．.]")
    items = F.split(F.coalesce(F.get(parts, F.lit(section)), F.lit("")), r"(?U)(?=\d+\s*[.．、])")
    items = F.filter(F.transform(items, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: F.length(p) >= least)
    codes = lambda p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(p, F.lit(config.CLAUSE_CODE), F.lit(0)), lambda c: F.replace(c, F.lit("-"), F.lit("")))))
    return F.transform(items, lambda p: F.struct(match.first_label(p, elements, otherwise).alias("element"), F.substring(F.regexp_replace(p, r"(?U)\s+", " "), 1, most).alias("text"), codes(p).alias("standards")))


def lines(frame: DataFrame, body: str, keys: Sequence[str], heading: str = r"^#+\s*(.+)$", most: int = 500) -> DataFrame:
    """Non-blank lines with their number (from 1) and the last heading at or before each."""
    rows = exploded(frame.select(*keys, F.split(body, "\n").alias("l")), F.col("l"), "line").drop("l")
    found = F.nullif(F.regexp_extract("line", heading, 1), F.lit(""))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section_title", F.coalesce(F.last(found, ignorenulls=True).over(order), F.lit("")))
    return rows.where(F.trim("line") != "").select(*keys, (F.col("pos") + 1).alias("line_start"), "section_title", F.substring("line", 1, most).alias("text"))


def theory_index(files: DataFrame) -> DataFrame:
    """One row for each non-blank line of files (path, body): its concept (the last heading of one to three
    marks at or before it), start and what it is related to. Without files one placeholder row."""
    s = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = lines(files, "body", ["path"], config.THEORY_HEADING, 1 << 30).withColumn("text", s).where("text != ''")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"^(\.*[^.].*)\.[^.]*$", "$1")
    at = (F.col("line_start") - 1).cast("int")
    constant = [F.lit("theory_auxiliary_only").alias("evidence_role"), F.lit(False).alias("can_support_gold_answer")]
    body = F.col("text")
    index = rows.select(
        F.format_string("%s_%04d", stem, at).alias("theory_id"), F.col("section_title").alias("concept"), match.expanded(body, config.THEORY_ALIASES).alias("aliases"), F.substring(body, 1, 300).alias("definition"),
        match.terms_in(body, config.THEORY_PROCESSES).alias("related_processes"), match.terms_in(body, config.THEORY_POLLUTANTS).alias("related_pollutants"), match.terms_in(body, config.THEORY_MEASURES).alias("related_measures"),
        match.risks(body, config.RISKS).alias("risk_warnings"), F.col("path").alias("source_file"), at.alias("line_start"), at.alias("line_end"), F.lit("llm_generated_unchecked").alias("review_status"), *constant,
    )
    name, concept, told = (F.lit(x) for x in config.THEORY_MISSING)
    none = F.array().cast("array<string>")
    missing = files.agg(F.count("*").alias("n")).where("n = 0").select(
        name.alias("theory_id"), concept.alias("concept"), none.alias("aliases"), told.alias("definition"), none.alias("related_processes"), none.alias("related_pollutants"), none.alias("related_measures"), none.alias("risk_warnings"),
        F.lit("").alias("source_file"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("unknown").alias("review_status"), *constant,
    )
    return index.unionByName(missing)


def sections(frame: DataFrame, body: str, keys: Sequence[str], heading: str = r"^(?U:\s)*([一二三四五六七八九十]+)、") -> DataFrame:
    """``sections``: numeral to its lines joined; what stands before the first numeral goes, and the last
    of repeated numerals wins."""
    rows = exploded(frame.select(*keys, F.split(body, "\n").alias("l")), F.col("l"), "line").drop("l")
    found = F.nullif(F.regexp_extract("line", heading, 1), F.lit(""))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("numeral", F.last(found, ignorenulls=True).over(order)).withColumn("part", F.count(found).over(order)).where("part > 0")
    joined = rows.groupBy(*keys, "part", "numeral").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "").alias("text"))
    last = joined.groupBy(*keys, "numeral").agg(F.max_by("text", "part").alias("text"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("numeral", "text")))).alias("sections"))


def conditions(frame: DataFrame, section: Column, keys: Sequence[str], elements: dict[str, Sequence[str]], most: int = 300) -> DataFrame:
    """For each element with a sentence of its own: its codes, limits and a snippet, as a map."""
    from ..functions import extract

    rows = frame.select(*keys, sentence_array(section, leads=False, least=1, most=100_000).alias("s"))
    entries = []
    for name, terms in elements.items():
        own = F.filter("s", _holds_any(terms))
        joined = F.array_join(own, "。")
        entries.append(F.when(F.size(own) > 0, F.struct(F.lit(name).alias("key"), F.struct(F.array_sort(extract.codes(joined)).alias("standards"), extract.limits(joined).alias("limits"), F.substring(joined, 1, most).alias("text_snippet")).alias("value"))))
    return rows.select(*keys, F.map_from_entries(match.present(entries)).alias("conditions"))


def _holds_any(terms: Sequence[str]):
    return lambda s: match.contains_any(s, terms)


def fanned(frame: DataFrame, elements: Sequence[str], name: str = "element") -> DataFrame:
    """Every row once for each element."""
    return frame.withColumn(name, F.explode(F.array(*[F.lit(e) for e in elements])))


def split_elements(frame: DataFrame, elements: str, answer: str, keywords: dict[str, Sequence[str]], most: int = 500) -> DataFrame:
    """Rows of several elements, one for each with only its own sentences; others unchanged."""
    sentences = F.split(answer, "[。；;]")
    own = F.array(*[F.struct(F.lit(e).alias("element"), F.substring(F.array_join(F.filter(sentences, _holds_any(terms)), "；"), 1, most).alias("part")) for e, terms in keywords.items()])
    wanted = F.filter(own, lambda o: F.array_contains(elements, o["element"]))
    whole = F.transform(elements, lambda e: F.struct(e.alias("element"), F.col(answer).alias("part")))
    rows = frame.withColumn("o", F.explode(F.when(F.size(elements) > 1, wanted).otherwise(whole)))
    return rows.withColumn("element", F.col("o.element")).withColumn(answer, F.col("o.part")).drop("o")


def first_exploded(frame: DataFrame, array: str, n: int, name: str) -> DataFrame:
    """One row for each of the first n elements, with its number from 1."""
    return exploded(frame, F.slice(array, 1, n), name, "index").withColumn("index", F.col("index") + 1)
