"""Text cleaning and string scalars: Column -> Column, all of them native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

CJK = r"\u4e00-\u9fff"


def collapse(x: Column) -> Column:
    """Every run of white space (any script's) to one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def without_details(x: Column, by: str = "") -> Column:
    return F.regexp_replace(x, r"(?s)<details>.*?</details>", by)


def clean_text(x: Column) -> Column:
    """Folded details and images become a blank, white space is collapsed."""
    return collapse(F.regexp_replace(without_details(x, " "), r"!\[[^\]]*\]\([^)]+\)", " "))


def clean_markdown(x: Column) -> Column:
    """As ``clean_text``, but lines stay; three or more line ends become two."""
    x = F.regexp_replace(without_details(x), r"!\[[^\]]*\]\([^)]*\)", "")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_html(x: Column) -> Column:
    return collapse(F.regexp_replace(x, r"(?i)</?[a-z]+[^>]*>", ""))


def normalize(x: Column) -> Column:
    """The key that names are matched by: CJK and ASCII letters and digits, in lower case."""
    return F.lower(F.regexp_replace(x, rf"[^{CJK}A-Za-z0-9]", ""))


def cjk_only(x: Column) -> Column:
    return F.regexp_replace(x, rf"[^{CJK}]", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def strip(x: Column, marks: str) -> Column:
    """Without the given characters at both ends."""
    return F.btrim(x, F.lit(marks))


def head(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def tail(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.right(x, F.lit(n))).otherwise(x)


def default(x: Column, value: str = "") -> Column:
    """The value where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(value))


def joined(x: Column, by: str = ";") -> Column:
    return F.array_join(x, by)


def listed(x: Column, by: str = ";") -> Column:
    """The inverse of ``joined``: an empty string is an empty list."""
    return F.when(default(x) == "", F.array().cast("array<string>")).otherwise(F.split(x, F.lit(by)))


def after_last(x: Column, mark: str = "_") -> Column:
    return F.when(F.instr(x, mark) > 0, F.substring_index(x, mark, -1)).otherwise(F.lit(""))


def numbered(pattern: str, order: Sequence[Column]) -> Column:
    """Ids such as F000001 by a stated order. The number is global, hence one task: number results,
    not sources."""
    return F.format_string(pattern, F.row_number().over(Window.orderBy(*order)))


def rendered(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def looked_up(key: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    """A small constant map with a default."""
    found = F.lit(None).cast("string")
    if table:
        found = F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def blob(columns: Sequence[Column], texts: Sequence[Column] = ()) -> Column:
    """One searchable text from some columns and arrays of texts."""
    return F.concat_ws(" ", *columns, *[F.array_join(t, " ") for t in texts])


def json_head(x: Column, n: int = 500) -> Column:
    return F.substring(F.to_json(x), 1, n)


def repaired(x: Column, keywords: Sequence[str], markers: Sequence[str] = ("鐨", "鍏", "涓", "椤", "鎵")) -> Column:
    """UTF-8 text that was read as GBK, turned back: only if two markers occur, the bytes are valid,
    and no fewer keywords are found. Needs the session's charset settings."""
    from .match import hit_count

    turned = F.encode(x, "GBK").cast("string")
    bad = (hit_count(x, markers) >= 2) & F.is_valid_utf8(turned)
    return F.when(bad & (hit_count(turned, keywords) >= hit_count(x, keywords)), turned).otherwise(x)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as GB18030, without a byte-order mark."""
    text = content.cast("string")
    return F.ltrim(F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "GB18030")), F.lit("\ufeff"))


def rewritten(old: Column, new: Column) -> Column:
    """struct(question, original_question, changed)."""
    return F.struct(new.alias("question"), old.alias("original_question"), (~old.eqNullSafe(new)).alias("changed"))


def context(ident: Column, report: Column, approval: Column, standard: Column, history: Column) -> Column:
    """The input context of a sample: texts cut to 5000, 3000, 2000 and 3000 characters, and a mark where
    the report is not loaded."""
    missing = F.concat(F.lit("[PLACEHOLDER: "), ident, F.lit(" report text — not yet loaded]"))
    return F.struct(
        F.coalesce(F.nullif(F.substring(report, 1, 5000), F.lit("")), missing).alias("report_text"), default(F.substring(approval, 1, 3000)).alias("approval_text"),
        default(F.substring(standard, 1, 2000)).alias("standard_text"), default(F.substring(history, 1, 3000)).alias("historical_case_context"),
    )
