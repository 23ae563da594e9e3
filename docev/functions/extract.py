"""Field extraction and reference codes: Column -> Column, all of them native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from . import match, text


def first_match(x: Column, patterns: Sequence[str], otherwise: str = "", most: int = 120, marks: str = config.EDGE_MARKS) -> Column:
    """The first pattern's group 1 that is not empty once white space is collapsed and the ends are
    stripped, cut to ``most`` characters."""
    found = [F.nullif(text.strip(F.regexp_replace(F.regexp_extract(x, f"(?s){p}", 1), r"(?U)\s+", " "), marks), F.lit("")) for p in patterns]
    return F.coalesce(*[F.substring(f, 1, most) for f in found], F.lit(otherwise))


def company(x: Column) -> Column:
    """A company's name from the first 8,000 characters, without lead words and project words."""
    name = first_match(F.substring(x, 1, 8000), config.COMPANY_PATTERNS)
    name = F.regexp_replace(name, "^(关于|公示|建设单位|项目单位)", "")
    name = F.regexp_replace(name, "(?s)(建设项目|新建项目|扩建项目|迁建项目|改扩建项目|环境影响.*)$", "")
    return text.strip(name, config.TITLE_MARKS)


def project_name(x: Column) -> Column:
    name = first_match(F.substring(x, 1, 10000), config.PROJECT_PATTERNS)
    return text.strip(F.regexp_replace(name, "(?s)环境影响报告[书表].*$", ""), config.TITLE_MARKS)


def report_type(x: Column, otherwise: str = "") -> Column:
    return match.ladder(F.substring(x, 1, 5000), [(["报告书"], "报告书"), (["报告表"], "报告表")], otherwise)


def project_type(x: Column, name: Column | None = None) -> Column:
    """From the project's name, else from the first 10,000 characters."""
    name = project_name(x) if name is None else name
    return F.coalesce(*[F.nullif(match.ladder(y, config.PROJECT_TYPES), F.lit("")) for y in (name, F.substring(x, 1, 10000))], F.lit(""))


def town(x: Column, towns: Sequence[str] = config.TOWNS, most: int = 12000) -> Column:
    """The first of the list that occurs, not the first in the text."""
    return match.ladder(F.substring(x, 1, most), [([t], t) for t in towns])


def year(x: Column, path: Column | None = None) -> Column:
    found = [F.nullif(F.regexp_extract(F.substring(x, 1, 5000), r"(20\d{2})(?U:\s)*年", 1), F.lit(""))]
    if path is not None:
        found.append(F.nullif(F.regexp_extract(path, r"(20\d{2})", 1), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def _iso(x: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract(x, pattern, k)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def date(x: Column, path: Column | None = None) -> Column:
    """YYYY-MM-DD from a date written out or in numbers, else the year in the path, else empty."""
    body = F.substring(x, 1, 12000)
    more = body if path is None else F.concat(body, F.lit(" "), path)
    found = [_iso(body, r"(20\d{2})(?U:\s)*年(?U:\s)*(\d{1,2})(?U:\s)*月(?U:\s)*(\d{1,2})(?U:\s)*日"), _iso(more, r"(20\d{2})[-./](\d{1,2})[-./](\d{1,2})")]
    if path is not None:
        found.append(F.nullif(F.regexp_extract(path, r"(20\d{2})", 1), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def doc_no(x: Column, path: Column | None = None) -> Column:
    body = F.substring(x, 1, 5000)
    return first_match(body if path is None else F.concat(path, F.lit("\n"), body), config.DOC_NO_PATTERNS)


def industry_code(x: Column, pattern: str = r"(?U)\b([A-Z]\d{4})\b", most: int = 15000) -> Column:
    return F.regexp_extract(F.substring(x, 1, most), pattern, 1)


def title(x: Column, lines: int = 30) -> Column:
    """The first of the leading lines that names a decision about something."""
    found = F.filter(F.slice(F.split(x, "\n"), 1, lines), lambda y: F.contains(y, F.lit("关于")) & (F.contains(y, F.lit("批复")) | F.contains(y, F.lit("环境影响报告"))))
    return F.coalesce(F.trim(F.get(found, F.lit(0))), F.lit(""))


def title_by_pattern(x: Column) -> Column:
    return F.regexp_extract(x, r"(关于[^。]{5,80}?的批复)", 1)


def approval_mode(x: Column) -> Column:
    return match.ladder(x, [(["告知承诺", "承诺制"], "告知承诺"), (["形式审查"], "形式审查")], "常规审批")


def limits(x: Column, names: Sequence[str] = config.POLLUTANTS, units: str = "mg/m3|mg/m³|mg/L|t/a|dB|吨/年|kg/h") -> Column:
    """All name, value and unit triples: an array of structs, the value a double."""
    pattern = rf"({'|'.join(names)})(?U:\s)*[:：≤≥≈](?U:\s)*(\d+(?:\.\d+)?)(?U:\s)*({units})"
    group = lambda k: F.regexp_extract_all(x, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"))
    return F.transform(zipped, lambda z: F.struct(z["a"].alias("name"), z["b"].try_cast("double").alias("value"), z["c"].alias("unit")))


def cap(x: Column, pattern: str = r"(\d+(?:\.\d+)?)(?U:\s)*(?:t/a|吨/年)") -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("double")


def claims(x: Column, patterns: Mapping[str, Sequence[str]], least: int = 6, most: int = 300, general: str = "general", whole: int = 200) -> Column:
    """Claims of every type: array of structs (claim, claim_type), in the order of types and patterns,
    stripped. Distinct by what is stored; a text without any is one general claim of its start."""

    def found_by(kind: str, pattern: str) -> Column:
        stripped = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
        long = F.filter(stripped, lambda c: F.length(c) >= least)
        return F.transform(long, lambda c: F.struct(F.substring(c, 1, most).alias("claim"), F.lit(kind).alias("claim_type")))

    found = [found_by(kind, p) for kind, group in patterns.items() for p in group]
    everything = F.flatten(F.array(*found))
    kept = F.filter(everything, lambda c, k: F.array_position(F.transform(everything, lambda d: d["claim"]), c["claim"]) == k + 1)
    start = F.array(F.struct(F.substring(x, 1, whole).alias("claim"), F.lit(general).alias("claim_type")))
    return F.when(F.size(kept) > 0, kept).otherwise(start)


# --- reference codes ------------------------------------------------------------------------


def normal_code(x: Column) -> Column:
    """One spelling of a code: upper case, no blanks, one kind of dash, four digits of the year."""
    c = F.regexp_replace(F.regexp_replace(F.upper(x), r"(?U)\s+", ""), "[—－]", "-")
    c = F.regexp_replace(c, r"^(DB\d{2})(\d)", "$1/$2")
    stem = r"^((?:GB/T|GB|HJ/T|HJ|DB\d{2}/T|DB\d{2}/)\d{1,6})"
    c = F.regexp_replace(c, rf"{stem}(\d{{4}})$", "$1-$2")
    short = F.regexp_extract(c, rf"{stem}-(\d{{2}})$", 2)
    century = F.when(short.try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20"))
    return F.when(short != "", F.concat(F.regexp_extract(c, rf"{stem}-(\d{{2}})$", 1), F.lit("-"), century, short)).otherwise(c)


def valid_code(x: Column, pattern: str = config.STANDARD_VALID) -> Column:
    return F.coalesce(x.rlike(pattern), F.lit(False))


def codes(x: Column, pattern: str = config.STANDARD_PATTERN) -> Column:
    """Normal, valid codes in the order of their first mention."""
    mentioned = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), normal_code)
    return F.array_distinct(F.filter(mentioned, lambda c: valid_code(c)))


def known_code(x: Column, known: Mapping[str, str]) -> Column:
    """A known spelling's code, else upper case without blanks, with one kind of dash, and one before four
    digits that end it. Two digits of a year stay two."""
    c = F.regexp_replace(text.compact(F.upper(x)), "[—－]", "-")
    plain = F.regexp_replace(c, r"^(DB\d{2})(\d)", "$1/$2")
    plain = F.regexp_replace(plain, r"^((?:GB/T|GB|HJ/T|HJ|DB\d{2}/T|DB\d{2}/)\d{1,6})(\d{4})$", "$1-$2")
    return F.coalesce(text.looked_up(c, dict(known)), plain)


def mentions(x: Column, pattern: str = config.MENTION_PATTERN, known: Mapping[str, str] = config.KNOWN_CODES) -> tuple[Column, Column]:
    """Good mentions, distinct, and bad ones (bare codes, outlets) as often as they occur."""
    mentioned = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda c: known_code(c, known))
    good = lambda c: valid_code(c, config.MENTION_VALID)
    return F.array_distinct(F.filter(mentioned, good)), F.filter(mentioned, lambda c: ~good(c))


def allowed_codes(xs: Column, prefixes: Sequence[str]) -> Column:
    """Codes with one of the prefixes; without prefixes all stay."""
    if not prefixes:
        return xs
    return F.filter(xs, lambda c: match.contains_any(c, prefixes))


def library_code(x: Column) -> Column:
    """The looser spelling of the rule library: no blanks, one kind of dash and slash, a dash before the
    year only of codes without a slash."""
    c = F.translate(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "—－／ \u3000", "--/")
    return F.regexp_replace(c, r"^([A-Z]{1,3}\d{2,6})(\d{4})$", "$1-$2")


def library_valid(c: Column) -> Column:
    return (F.length(c) >= 6) & c.rlike(r"^(GB|HJ|DB\d{2})")


def fitting_codes(element: Column, xs: Column, fitting: Mapping[str, Sequence[str]] = config.ELEMENT_STANDARDS) -> Column:
    """Codes that hold one of their element's prefixes; all codes of an unknown element."""
    out = F.when(F.lit(False), xs)
    for name, prefixes in fitting.items():
        out = out.when(element == name, allowed_codes(xs, prefixes))
    return out.otherwise(xs)


def element_codes(element: Column, answer: Column, scoped: Mapping[str, Sequence[str]] = config.SCOPED_STANDARDS) -> Column:
    """The answer's codes; elements with a scope keep only codes that begin with its prefixes."""
    found = codes(answer)
    out = F.when(F.lit(False), found)
    for name, prefixes in scoped.items():
        out = out.when(element == name, _starting(found, prefixes))
    return out.otherwise(found)


def _starting(xs: Column, prefixes: Sequence[str]) -> Column:
    return F.filter(xs, lambda c: _starts(c, prefixes))


def _starts(c: Column, prefixes: Sequence[str]) -> Column:
    held = F.lit(False)
    for p in prefixes:
        held = held | F.startswith(c, F.lit(p))
    return held


def without_other_codes(x: Column) -> Column:
    """A hazardous-waste answer without the standards of general solid waste."""
    x = F.regexp_replace(x, r"[，,、]?[《〈][^》〉]{0,60}(?:一般工业固体废物|固体废物贮存|固体废物污染)[^》〉]*[》〉][（(]GB18599-\d{4}[）)]", "")
    x = F.regexp_replace(x, r"[，,、]?以及[《〈]关于发布[《〈]一般工业[^。；;]*GB18599-\d{4}[^。；;]*", "")
    return text.strip(F.regexp_replace(x, r"[，,、]?GB18599-\d{4}", ""), " ，,、。；;")


def sound_codes(xs: Column, least: int = 5) -> Column:
    """Without empty, bare and outlet codes."""
    return F.filter(xs, lambda c: ~c.isin(*config.CHECK_GARBAGE) & (F.length(c) >= least))


def with_cited(xs: Column, answer: Column) -> Column:
    """The codes, then those and the titles that the answer cites."""
    cited = F.concat(F.regexp_extract_all(answer, F.lit(r"([A-Z]{2}\d+[0-9./-]*)"), F.lit(1)), F.regexp_extract_all(answer, F.lit(r"《([^》]+)》"), F.lit(1)))
    return F.array_distinct(F.concat(xs, cited))


def file_guesses(name: Column) -> dict[str, Column]:
    """What a file's name tells: a year, a company, a document number, and whether it may be a decision."""
    return {
        "year_guess": F.regexp_extract(name, config.FILE_YEAR, 1), "company_guess": F.trim(F.regexp_extract(name, config.FILE_COMPANY, 1)), "doc_no_guess": F.regexp_extract(name, config.FILE_DOC_NO, 1),
        "maybe_approval": match.contains_any(name, config.FILE_DECISIONS),
    }


def project_id(path: Column) -> Column:
    """A pair's name in a path, else a 32-digit or dashed hexadecimal id."""
    found = [F.regexp_extract(path, r"(pair_\d+)", 1), F.regexp_extract(path, r"(?i)([a-f0-9]{32}|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})", 1)]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))


def standard_code(x: Column) -> Column:
    """The first code as it is written, a dated one before one without a year."""
    stem = r"(?:GB|HJ|DB\d{2}|GB/T|HJ/T|DB\d{2}/T)\s*[\d.]+"
    return F.coalesce(*[F.nullif(F.regexp_extract(x, f"(?i)({p})", 1), F.lit("")) for p in (rf"{stem}[-—]\s*\d{{4}}", stem)], F.lit(""))


def loose_codes(x: Column) -> Column:
    """Everything that looks like a dated code, sorted; the class of letters over-matches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(config.CLAUSE_CODE), F.lit(0))))


def routes_differ(answer: Column, evidence: Column, pattern: str = config.DISCHARGE, size: int = 8) -> Column:
    """Both name a discharge route, and the first ones begin differently."""
    first = lambda x: F.substring(F.regexp_extract(x, pattern, 1), 1, size)
    return (first(answer) != "") & (first(evidence) != "") & (first(answer) != first(evidence))
