"""Keyword predicates and classifiers: Column -> Column, all of them native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def contains_any(x: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in terms if t], F.lit(False))


def hit_count(x: Column, terms: Sequence[str]) -> Column:
    """How many different terms occur."""
    return reduce(lambda a, b: a + b, [F.contains(x, F.lit(t)).cast("int") for t in terms], F.lit(0))


def ladder(x: Column, steps: Sequence[tuple[Sequence[str], str]], otherwise: str = "") -> Column:
    """The label of the first step any of whose terms occurs."""
    found = F.when(contains_any(x, steps[0][0]), F.lit(steps[0][1]))
    for terms, label in steps[1:]:
        found = found.when(contains_any(x, terms), F.lit(label))
    return found.otherwise(F.lit(otherwise))


def priority(x: Column, report: Sequence[str], approval: Sequence[str], public: Sequence[str], hint: str = "批复") -> Column:
    """The type of a cleaned text head: struct of type and confidence. Public participation comes first,
    then the approval if it has at least as many hits as the report."""
    r, a, p = hit_count(x, report), hit_count(x, approval), hit_count(x, public)
    pick = lambda kind, confidence: F.struct(F.lit(kind).alias("type"), confidence.cast("int").alias("confidence"))
    capped = lambda n: F.least(F.lit(100), n * 12)
    return (
        F.when((p >= 2) & (r < 4), pick("public_participation", p * 20))
        .when((a >= 3) & (a >= r), pick("approval", capped(a)))
        .when(r >= 3, pick("report", capped(r)))
        .when((a >= 2) & F.contains(F.substring(x, 1, 1500), F.lit(hint)), pick("approval", capped(a)))
        .otherwise(pick("unknown", F.lit(0)))
    )


def weighted(windows: Sequence[tuple[Column, Sequence[str], int]], least: int, label: str, otherwise: Column) -> Column:
    """A label if hits over several windows, each with its weight, reach a threshold."""
    total = reduce(lambda a, b: a + b, [hit_count(x, terms) * weight for x, terms, weight in windows])
    return F.when(total >= least, F.lit(label)).otherwise(otherwise)


def scanned_kind(
    body: Column, path: Column, approval: Sequence[str] = config.SCAN_APPROVAL, report: Sequence[str] = config.SCAN_REPORT, public: Sequence[str] = config.SCAN_PUBLIC,
    names: Sequence[tuple[Sequence[str], str]] = config.SCAN_NAMES,
) -> Column:
    """The type of a scanned file: struct of type and how it was told. Two terms tell it by content, an approval's in
    the first 500 characters, a report's in 2000, public participation's anywhere in lower case; approval and report
    need more than the other has. Else the file's name tells it. A null body is unreadable."""
    told = lambda kind, how: F.struct(F.lit(kind).alias("type"), F.lit(how).alias("how"))
    a, r, p = hit_count(F.substring(body, 1, 500), approval), hit_count(F.substring(body, 1, 2000), report), hit_count(F.lower(body), public)
    kind = ladder(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1), names)
    found = F.when(body.isNull(), told("unknown", "unreadable"))
    found = found.when((a >= 2) & (a > r), told("approval", "content_matched")).when((r >= 2) & (r > a), told("report", "content_matched")).when(p >= 2, told("public_participation", "content_matched"))
    return found.when(kind != "", F.struct(kind.alias("type"), F.lit("filename_fallback").alias("how"))).otherwise(told("unknown", "no_match"))


def best_label(x: Column, labels: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The label with most hits; the first of equals; ``otherwise`` without a hit."""
    scored = F.array(*[F.struct(hit_count(x, terms).alias("n"), F.lit(-k).alias("k"), F.lit(label).alias("label")) for k, (label, terms) in enumerate(labels.items())])
    top = F.array_max(scored)
    return F.when(top["n"] > 0, top["label"]).otherwise(F.lit(otherwise))


def first_label(x: Column, labels: Mapping[str, Sequence[str]], otherwise: str = "") -> Column:
    return ladder(x, [(terms, label) for label, terms in labels.items()], otherwise)


def all_labels(x: Column, labels: Mapping[str, Sequence[str]], otherwise: str | None = None) -> Column:
    """All labels with a hit, in their order."""
    found = present([F.when(contains_any(x, terms), F.lit(label)) for label, terms in labels.items()])
    return found if otherwise is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def matched_labels(x: Column, patterns: Mapping[str, str], base: Sequence[Column] = (), otherwise: str | None = None) -> Column:
    """Labels from other maps, then those whose pattern is found in the lower-cased text; distinct, in
    order."""
    found = present([*base, *[F.when(F.lower(x).rlike(p), F.lit(label)) for label, p in patterns.items()]])
    found = F.array_distinct(found)
    return found if otherwise is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def present(options: Sequence[Column]) -> Column:
    """The options that aren't null, as an array."""
    return F.filter(F.array(*options), lambda v: v.isNotNull()) if options else F.array().cast("array<string>")


def terms_in(x: Column, terms: Sequence[str]) -> Column:
    """The terms that occur, in the dictionary's order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t))


def sorted_terms(x: Column, terms: Sequence[str]) -> Column:
    return F.array_sort(F.array_distinct(terms_in(x, terms)))


def expanded(x: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """All aliases of the keys that occur, distinct, in order."""
    groups = [F.when(F.contains(x, F.lit(k)), F.array(*[F.lit(a) for a in v])) for k, v in aliases.items()]
    return F.array_distinct(F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull())))


def claim_pieces(claim: Column, size: int = 4) -> Column:
    """A claim's pieces of at least ``size`` characters, else its first ten characters; none of a claim
    that is shorter itself."""
    core = F.regexp_replace(claim, r"(?U)^\s+|\s+$", "")
    pieces = F.filter(F.split(core, r"(?U)[\s,，。；;、]"), lambda p: F.length(p) >= size)
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.substring(core, 1, 10)))
    return F.when(F.length(core) >= size, pieces).otherwise(F.array().cast("array<string>"))


def supported(claim: Column, text: Column, least: int = 2, share: float = 0.6, size: int = 4) -> Column:
    """Fuzzy containment: enough of the claim's pieces occur in the text. With ``least`` 2 a claim of one
    piece is never supported; 1 lifts that."""
    pieces = claim_pieces(claim, size)
    return F.size(F.filter(pieces, lambda p: F.contains(text, p))) >= F.greatest(F.lit(least), F.floor(F.size(pieces) * share).cast("int"))


def trimmed(answer: Column, most: int = 700) -> Column:
    """Short enough, and at most one numbered heading, the answer's prefix aside."""
    body = F.replace(answer, F.lit("批复要求："), F.lit(""))
    return (F.length(body) <= most) & (F.regexp_count(body, F.lit("[一二三四五六七八九十]+、")) <= 1)


def has_marker(x: Column, marker: str) -> Column:
    """A marker; standard codes are found across blanks."""
    return F.contains(F.regexp_replace(x, r"(?U)\s+", "") if marker.startswith("GB") else x, F.lit(marker))


def name_in_both(name: Column, one: Column, other: Column) -> Column:
    """Whether a normalised name's start or end is in both texts; names under eight characters pass."""
    keys = [F.substring(name, 1, 18), F.right(name, F.lit(18)), F.substring(name, 1, 12)]
    found = reduce(lambda a, b: a | b, [F.contains(one, k) & F.contains(other, k) for k in keys])
    return (F.length(name) < 8) | found


def banded(x: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first band, from the highest, whose lower bound x reaches."""
    found = F.when(x >= bands[0][0], F.lit(bands[0][1]))
    for least, label in bands[1:]:
        found = found.when(x >= least, F.lit(label))
    return found.otherwise(F.lit(otherwise))


def reasons(checks: Sequence[tuple[Column, str | Column]]) -> Column:
    """The codes of the checks that hold, in order: the shape of every audit here."""
    return present([F.when(check, F.lit(code) if isinstance(code, str) else code) for check, code in checks])


def industry(codes: Column, x: Column, by_code: Mapping[str, str], by_keyword: Sequence[tuple[Sequence[str], str]], otherwise: str = "其他") -> Column:
    """The industry of the first code whose base is known, else of the first keyword group."""
    bases = F.transform(codes, lambda c: F.regexp_replace(c, r"-\d{4}$", ""))
    out = ladder(x, by_keyword, otherwise)
    if by_code:
        table = F.create_map(*[F.lit(v) for kv in by_code.items() for v in kv])
        out = F.coalesce(F.get(F.filter(F.transform(bases, lambda b: F.try_element_at(table, b)), lambda v: v.isNotNull()), F.lit(0)), out)
    return out


def outdated(x: Column, versions: Sequence[tuple[str, str]]) -> Column:
    """struct(risk, warning): the first superseded version that is cited."""
    pick = lambda risk, warning: F.struct(F.lit(risk).alias("risk"), F.lit(warning).alias("warning"))
    found = F.when(F.contains(x, F.lit(versions[0][0])), pick("outdated", versions[0][1]))
    for code, warning in versions[1:]:
        found = found.when(F.contains(x, F.lit(code)), pick("outdated", warning))
    return found.otherwise(pick("none", ""))


def risks(x: Column, rules: Sequence[tuple[str, str | None, str]]) -> Column:
    """Warnings whose pattern is found and whose excuse, if any, is not."""
    return reasons([(x.rlike(p) if excuse is None else x.rlike(p) & ~x.rlike(excuse), warning) for p, excuse, warning in rules])


def preview(x: Column, report: Sequence[str], approval: Sequence[str], public: Sequence[str]) -> Column:
    """The type of a preview by doubled hits in windows of its start; a weak decision is a candidate."""
    a, r, p = hit_count(F.substring(x, 1, 1500), approval) * 2, hit_count(F.substring(x, 1, 2000), report) * 2, hit_count(F.substring(x, 1, 1000), public) * 2
    return F.when((a >= 4) & (a > r), "approval").when(r >= 4, "report").when(p >= 4, "public_participation").when(a > 0, "approval_candidate").otherwise("unknown")


def potential(strong: Column, one: Column, comments: Column) -> Column:
    """struct(potential, use) of a package as a benchmark source."""
    pick = lambda p, u: F.struct(F.lit(p).alias("potential"), F.lit(u).alias("use"))
    return F.when(strong & (comments >= 10), pick("high", "real_error_benchmark")).when(one & (comments >= 5), pick("medium", "real_error_benchmark")).when(comments >= 3, pick("low", "experience_rule_source")).otherwise(pick("low", "metadata_only"))
