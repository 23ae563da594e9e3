"""Evidence spans and snippets. Offsets are 0-based code points of the text that is given, ends exclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import match, text


def _earliest(x: Column, terms: Sequence[str]) -> Column:
    """The 0-based place of the earliest term; null without any."""
    return F.array_min(F.filter(F.array(*[F.instr(x, t) - 1 for t in terms if t]), lambda p: p >= 0))


def cut(x: Column, start: Column, end: Column) -> Column:
    return F.substring(x, start + 1, end - start)


def around_first(x: Column, terms: Sequence[str], before: int = 120, after: int = 260, otherwise: int = 300) -> Column:
    """A snippet at the earliest hit, else the start of the text."""
    at = _earliest(x, terms)
    start = F.greatest(F.lit(0), at - before)
    return F.when(at.isNotNull(), cut(x, start, F.least(F.length(x), at + after))).otherwise(F.substring(x, 1, otherwise))


def evidence(x: Column, terms: Sequence[str], window: int = 260) -> Column:
    """struct(text, char_start, char_end) around the earliest term of a cleaned text; null without any."""
    at = _earliest(x, terms)
    start, end = F.greatest(F.lit(0), at - window // 2), F.least(F.length(x), at + window)
    return F.when(at.isNotNull(), F.struct(cut(x, start, end).alias("text"), start.alias("char_start"), end.alias("char_end")))


def focus(x: Column, terms: Sequence[str], limit: int = 280, before: int = 80, marks: str = " ，,。；;") -> Column:
    """At most ``limit`` characters around the earliest term, with dots where it is cut."""
    at, size = _earliest(x, terms), F.length(x)
    end = F.least(size, F.greatest(F.lit(0), at - before) + limit)
    start = F.greatest(F.lit(0), F.least(at - before, end - limit))
    body = F.concat(F.when(start > 0, "...").otherwise(""), text.strip(cut(x, start, end), marks), F.when(end < size, "...").otherwise(""))
    return F.when(size <= limit, x).when(at.isNull(), F.rtrim(F.substring(x, 1, limit))).otherwise(body)


def anchored(x: Column, anchors: Sequence[str], stop: Column | None = None, before: int = 70, after: int = 150, marks: str = " ，,。；;", clean=lambda s: s) -> Column:
    """Distinct snippets at the first place of each anchor, joined; no more are taken once the joined
    text holds what ``stop(joined)`` asks for."""
    found = match.present([F.when(F.instr(x, a) > 0, F.nullif(clean(text.strip(cut(x, F.greatest(F.lit(0), F.instr(x, a) - 1 - before), F.instr(x, a) - 1 + after), marks)), F.lit(""))) for a in anchors])
    enough = stop or (lambda joined: F.lit(False))
    empty = F.lit("")
    return F.aggregate(F.array_distinct(found), empty, lambda kept, s: F.when(enough(kept), kept).when(kept == "", s).otherwise(F.concat(kept, F.lit("。"), s)))


def until(parts: Column, cap: int = 520, by: str = "。") -> Column:
    """The leading distinct parts until their joined length reaches the cap; the one that reaches it
    stays."""
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    grown = lambda a, p: F.struct((a["n"] + F.length(p) + F.when(F.size(a["kept"]) > 0, len(by)).otherwise(0)).alias("n"), F.concat(a["kept"], F.array(p)).alias("kept"))
    step = lambda a, p: F.when(a["n"] >= cap, a).otherwise(grown(a, p))
    return F.aggregate(F.array_distinct(parts), empty, step, lambda a: a["kept"])


def places(x: Column, term: Column) -> Column:
    """The 0-based places of all occurrences of a literal term that don't overlap."""
    pieces = F.split(x, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")), -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(term)).cast("int").alias("at"), F.concat(a["found"], F.array((a["at"] + F.length(p)).cast("int"))).alias("found"))
    return F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), empty, step, lambda a: a["found"])


def best_window(x: Column, own: Sequence[str], others: Column, excluded: Sequence[str] = (), before: int = 260, after: int = 520, most: int = 780,
                code: str = "^(GB|HJ|DB)") -> Column:
    """The window with the highest score among those at every place of every term: 3 a keyword of its
    own, 4 a code and 2 any other of the given terms; the leftmost of equals, and of those that begin at
    the same place the first by term and place; none with an excluded marker. Null without any."""
    terms = F.array_distinct(F.concat(F.array(*[F.lit(t) for t in own]), others))
    at = F.flatten(F.transform(F.filter(terms, lambda t: t != ""), lambda t: places(x, t)))
    window = lambda p: F.struct(F.greatest(F.lit(0), p - before).alias("left"), F.least(F.length(x), p + after).alias("right"))
    spans = F.transform(F.transform(at, window), lambda w: F.struct(w["left"].alias("left"), w["right"].alias("right"), F.trim(cut(x, w["left"], w["right"])).alias("text")))
    codes, plain = F.filter(others, lambda t: t.rlike(code)), F.filter(others, lambda t: ~t.rlike(code))
    among = lambda w, ts: F.size(F.filter(ts, lambda t: F.contains(w, t)))
    score = lambda w: match.hit_count(w, own) * 3 + among(w, codes) * 4 + among(w, plain) * 2
    spans = F.filter(spans, lambda w: ~match.contains_any(w["text"], excluded))
    scored = F.transform(spans, lambda w, k: F.struct(score(w["text"]).alias("score"), (-w["left"]).alias("order"), (-k).alias("rank"), w["right"].alias("right"), w["text"].alias("text")))
    best = F.array_max(F.filter(scored, lambda w: w["score"] > 0))
    left = -best["order"]
    return F.when(best.isNotNull(), F.struct(F.substring(best["text"], 1, most).alias("text"), left.alias("char_start"), F.least(best["right"], left + most).alias("char_end"), best["score"].alias("score")))


def anchor_search(x: Column, body: Column, terms: Column, prefix: int = 60) -> Column:
    """Where a body stands in a text: exactly, else around its first characters, else around the
    earliest of the terms, else nowhere (-1) with the body's start."""
    span = lambda t, a, b: F.struct(t.alias("text"), a.cast("int").alias("char_start"), b.cast("int").alias("char_end"))
    find = lambda needle: F.when(needle != "", F.position(needle, x) - 1).otherwise(F.lit(-1))
    exact = find(body)
    near = find(F.substring(body, 1, prefix))
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, x) - 1), lambda p: p >= 0))
    at = F.when(near >= 0, near).otherwise(first)
    start, end = F.greatest(F.lit(0), at - 50), F.least(F.length(x), at + F.least(F.lit(360), F.greatest(F.lit(160), F.length(body) + 80)))
    return (
        F.when((exact >= 0) & ~F.contains(body, F.lit("...")), span(body, exact, exact + F.length(body)))
        .when(at.isNotNull(), span(cut(x, start, end), start, end))
        .otherwise(span(F.substring(body, 1, 360), F.lit(-1), F.lit(-1)))
    )


def snippets(x: Column, terms: Column, around: int = 80, take: int = 3, first: int = 5) -> Column:
    """Up to ``take`` distinct snippets at the first places of the first terms."""
    found = F.transform(F.slice(terms, 1, first), lambda t: F.when(F.position(t, x) > 0, cut(x, F.greatest(F.lit(0), F.position(t, x) - 1 - around), F.position(t, x) - 1 + around)))
    return F.slice(F.array_distinct(F.filter(found, lambda s: s.isNotNull())), 1, take)
