"""Operator 4: personal data by patterns and a linear-chain conditional random field.

Base spans come from four patterns with checks; they always stay. The field, over word-shape features
of a token and its neighbours, adds spans that no base span overlaps: telephone numbers without a
country sign, and secrets such as access tokens. It is trained from a small labelled table (the lines
of ``pii_lines``, labelled by hand, and lines made by rule) by gradient ascent on the exact
log-likelihood, and decoded by Viterbi over batches of lines in numpy. A span must hold a digit or an
'@', so lines without either need no decoding; whole lines are decoded whatever their length, a long
one as segments side by side, whose best paths for every label before them are joined. Texts without
either never leave the JVM.

Defined results: a null or empty text has no spans; repeated rows are each searched; null ids stay
null; an empty table gives no rows. Offsets are code points, ends exclusive. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pii_lines

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of a spans string: the base ones, then what only the field finds.
ALL_KINDS = (*KINDS, "secret")
LABELS = ("O", "B-phone", "I-phone", "B-secret", "I-secret")

Span = tuple[str, int, int]

# The patterns of the contract. Quantifiers are possessive, and a run of digits is tried at its start
# only, where that can't change a match: a text of one long run stays linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local parts are found backwards from each '@', so that long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind and then start."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 60 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(m[0].count(d) for d in "0123456789") <= 15]
    return spans


# --- the field ---------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\x00-\x7f]+|[^\x20\x09-\x0D]")
NEIGHBOURS = (-2, -1, 0, 1, 2)
#: Tokens from which a line is decoded in segments.
LONG_LINE = 20_000
CUES = frozenset("token key secret password apikey api tel phone call fax mobile".split())


def shape(token: str, spaced: bool) -> str:
    """A token's class: its kinds of letters, a band of its length, and whether a blank precedes it."""
    lead = " " if spaced else ""
    if token.lower() in CUES:
        return lead + "cue:" + token.lower()
    n = len(token)
    band = str(n) if n <= 4 else "5-8" if n <= 8 else "9-15" if n <= 15 else "16-31" if n <= 31 else "32+"
    if token.isdigit() and token.isascii():
        return f"{lead}d{band}"
    if token.isascii() and token.isalnum():
        if not any(c.isdigit() for c in token):
            return lead + ("A" if token.isupper() else "a") + ("1" if n == 1 else "+")
        return f"{lead}{'h' if re.fullmatch('[0-9a-f]+|[0-9A-F]+', token) else 'x'}{band}"
    return lead + (token if n == 1 and token.isascii() else "u")


def tokens(line: str) -> tuple[list[tuple[int, int]], list[str]]:
    spans = [m.span() for m in _TOKEN.finditer(line)]
    return spans, [shape(line[a:b], a == 0 or line[a - 1] in " \t\v\f\r") for a, b in spans]


def labelled(line: str, spans: list[Span]) -> tuple[list[str], list[str]]:
    """Shapes and labels of a line's tokens."""
    places, shapes = tokens(line)
    labels = ["O"] * len(places)
    for kind, start, end in spans:
        for k, (a, b) in enumerate(places):
            if b > start and a < end:
                labels[k] = f"{'B' if a <= start else 'I'}-{kind}"
    return shapes, labels


def by_hand(copies: int = 2) -> list[tuple[list[str], list[str]]]:
    """The hand-labelled lines; each counts ``copies`` times beside those made by rule."""
    return [labelled(*pii_lines.parsed(line)) for line in pii_lines.LINES] * copies


def table(rows: int = 240, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The lines made by rule: shapes and labels. A third hold a telephone number, a third a secret, the
    rest numbers of other kinds: years, prices, versions, addresses, cards, dates."""
    draw = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    pick = lambda *x: x[draw.integers(len(x))]
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(draw.choice(list(letters), draw.integers(1, 9))) + pick("", "", "", ",", ".", "***", "!!")
    alnum = lambda n: "".join(draw.choice(list(letters + letters.upper() + "0123456789"), n - 2)) + number(1) + pick(*letters)
    hexed = lambda n: "".join(draw.choice(list("0123456789abcdef"), n - 2)) + number(1) + pick(*"abcdef")
    phones = (
        lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}",
        lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"+{number(2)} {number(3)} {number(3)} {number(4)}", lambda: f"0{number(2)} {number(4)} {number(4)}",
    )
    secrets = (lambda: hexed(40), lambda: hexed(32), lambda: alnum(24), lambda: alnum(36))
    others = (
        lambda: pick("19", "20") + number(2), lambda: number(pick(1, 2, 3, 4, 5, 6)), lambda: f"{number(2)}.{number(2)}", lambda: f"{number(1)},{number(3)},{number(3)}",
        lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(2)}.{number(3)}.{number(2)}.{number(3)}", lambda: number(16),
        lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}", lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(3)}-{number(1)}", lambda: f"{number(2)}@mail{number(1)}.example.com",
        lambda: f"{number(5)}-{number(5)}-{number(5)}", lambda: f"{number(2)} {number(3)} {number(2)}", lambda: f"a{number(2)}b", lambda: f"https://a.example/{number(6)}",
    )
    found = []
    for k in range(rows):
        before, after = [word() for _ in range(draw.integers(1, 6))], [word() for _ in range(draw.integers(1, 6))]
        cue, span, kind = "", None, None
        if k % 3 == 0:
            cue, span, kind = pick("", "", "tel ", "phone: ", "call "), pick(*phones)(), "phone"
        elif k % 3 == 1:
            cue, span, kind = pick('token = "', "key=", "secret: ", 'api_key = "', "password: "), pick(*secrets)(), "secret"
        else:
            span = pick(*others)()
        line = " ".join(before) + " " + cue
        start = len(line)
        line += span + ('"' if cue.endswith('"') else "") + pick("", "", ".", ",", "***") + " " + " ".join(after)
        found.append(labelled(line, [(kind, start, start + len(span))] if kind else []))
    return found


class Field:
    """Weights: emission[neighbour, shape, label], transition[label, label] and start[label]."""

    def __init__(self, shapes: dict[str, int], emission: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.shapes, self.emission, self.transition, self.start = shapes, emission, transition, start

    def scores(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores of lines padded to one length, and their lengths."""
        lengths = np.array([len(x) for x in lines])
        ids = np.zeros((len(lines), lengths.max() + 4), np.int64)  # shape 0: unknown or none
        for k, line in enumerate(lines):
            ids[k, 2 : 2 + len(line)] = [self.shapes.get(s, 0) for s in line]
        n = ids.shape[1] - 4
        return sum(self.emission[j, ids[:, 2 + d : 2 + d + n]] for j, d in enumerate(NEIGHBOURS)), lengths

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each line, by Viterbi over the whole batch at once."""
        if len(lines) == 1 and len(lines[0]) > LONG_LINE:
            return [self.decode_long(self.scores(lines)[0][0])]
        scores, lengths = self.scores(lines)
        m, n, k = scores.shape
        best, back = self.start + scores[:, 0], np.zeros((n, m, k), np.int8)
        for t in range(1, n):
            paths = best[:, :, None] + self.transition
            back[t] = paths.argmax(1)
            step = np.take_along_axis(paths, back[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[:, t]
            live = (t < lengths)[:, None]
            back[t] = np.where(live, back[t], np.arange(k))
            best = np.where(live, step, best)
        labels = np.zeros((m, n), np.int64)
        labels[:, n - 1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            labels[:, t - 1] = back[t][np.arange(m), labels[:, t]]
        return [labels[i, : lengths[i]] for i in range(m)]

    def decode_long(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of one long line. Its segments step side by side: first the best score from
        each label before a segment to each at its end, which are joined in order; then each segment's
        path between the labels so found at its ends."""
        n, k = scores.shape
        step = int(np.ceil(np.sqrt(n)))
        m = -(-n // step)
        padded = np.zeros((m * step, k))
        padded[:n] = scores
        live = (np.arange(m * step) < n).reshape(m, step)
        padded = padded.reshape(m, step, k)
        enter = np.repeat(self.transition[None], m, 0)
        enter[0] = self.start  # before the line there is no label
        reach = enter + padded[:, 0][:, None, :]
        for t in range(1, step):
            after = (reach[:, :, :, None] + self.transition).max(2) + padded[:, t][:, None, :]
            reach = np.where(live[:, t, None, None], after, reach)
        best, came = np.zeros(k), np.zeros((m, k), np.int64)
        for b in range(m):
            paths = best[:, None] + reach[b]
            came[b] = paths.argmax(0)
            best = paths.max(0)
        last = np.empty(m, np.int64)
        label = int(best.argmax())
        for b in range(m - 1, -1, -1):
            last[b] = label
            label = came[b, label]
        first = enter[np.arange(m), np.concatenate([[0], last[:-1]])]
        at, back = first + padded[:, 0], np.zeros((step, m, k), np.int8)
        for t in range(1, step):
            paths = at[:, :, None] + self.transition
            back[t] = np.where(live[:, t, None], paths.argmax(1), np.arange(k))
            at = np.where(live[:, t, None], paths.max(1) + padded[:, t], at)
        labels = np.empty((m, step), np.int64)
        labels[:, step - 1] = last
        for t in range(step - 1, 0, -1):
            labels[:, t - 1] = back[t][np.arange(m), labels[:, t]]
        return labels.reshape(-1)[:n]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(1)
def train(steps: int = 150, rate: float = 0.1, ridge: float = 0.01) -> Field:
    """Adam on the penalised log-likelihood; gradients by forward-backward over the padded table."""
    rows = table() + by_hand()
    shapes = {s: k + 1 for k, s in enumerate(sorted({s for line, _ in rows for s in line}))}
    k = len(LABELS)
    field = Field(shapes, np.zeros((len(NEIGHBOURS), len(shapes) + 1, k)), np.zeros((k, k)), np.zeros(k))
    index = {label: i for i, label in enumerate(LABELS)}
    # An inside label follows only its own begin or inside.
    barred = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
    barred_start = np.array([b.startswith("I-") for b in LABELS])
    lines = [x for x, _ in rows]
    lengths = np.array([len(x) for x in lines])
    m, n = len(rows), int(lengths.max())
    ids = np.zeros((m, n + 4), np.int64)
    gold = np.zeros((m, n), np.int64)
    for r, (line, labels) in enumerate(rows):
        ids[r, 2 : 2 + len(line)] = [shapes[s] for s in line]
        gold[r, : len(labels)] = [index[x] for x in labels]
    live = np.arange(n) < lengths[:, None]
    one = np.eye(k)[gold] * live[..., None]
    both = live[:, 1:] & live[:, :-1]
    seen = (one[:, :-1, :, None] * one[:, 1:, None, :] * both[..., None, None]).sum((0, 1))
    weights = [field.emission, field.transition, field.start]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        scores, _ = field.scores(lines)
        transition = np.where(barred, -1e4, field.transition)
        forward, backward = np.zeros((m, n, k)), np.zeros((m, n, k))
        forward[:, 0] = np.where(barred_start, -1e4, field.start) + scores[:, 0]
        for t in range(1, n):
            stepped = _logsum(forward[:, t - 1, :, None] + transition, 1) + scores[:, t]
            forward[:, t] = np.where(live[:, t, None], stepped, forward[:, t - 1])
        for t in range(n - 2, -1, -1):
            stepped = _logsum(transition + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], stepped, backward[:, t + 1])
        total = _logsum(forward[:, -1], 1)
        mass = np.exp(forward + backward - total[:, None, None]) * live[..., None]
        arcs = forward[:, :-1, :, None] + transition + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(arcs, 0)) * both[..., None, None]).sum((0, 1))
        off = one - mass
        emission = np.zeros_like(field.emission)
        for j, d in enumerate(NEIGHBOURS):
            np.add.at(emission[j], ids[:, 2 + d : 2 + d + n], off)
        for w, g, (first, second) in zip(weights, (emission, seen - expected, off[:, 0].sum(0)), moments, strict=True):
            g = g - ridge * w * m / 10
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            w += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    field.transition = np.where(barred, -1e4, field.transition)
    field.start = np.where(barred_start, -1e4, field.start)
    return field


def accepted(kind: str, text: str) -> bool:
    """The least a found span must hold."""
    digits = len(_digits(text))
    return 7 <= digits <= 15 if kind == "phone" else digits >= 1 and len(text) >= 16


def found_spans(texts: list[str], field: Field, base: list[list[Span]]) -> list[list[Span]]:
    """What the field adds to each text. Lines are decoded in batches of similar length."""
    where, lines, places = [], [], []
    for k, text in enumerate(texts):
        start = 0
        for line in text.split("\n"):
            if re.search("[0-9@]", line):
                spans, shapes = tokens(line)
                where.append((k, start))
                lines.append(shapes)
                places.append(spans)
            start += len(line) + 1
    out: list[list[Span]] = [[] for _ in texts]
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    for a, b in _batches([len(lines[i]) for i in order]):
        chosen = order[a:b]
        for i, labels in zip(chosen, field.decode([lines[i] for i in chosen]), strict=True):
            k, shift = where[i]
            spans, t = places[i], 0
            while t < len(labels):
                name = LABELS[labels[t]]
                last = t
                if name.startswith("B-"):
                    while last + 1 < len(labels) and LABELS[labels[last + 1]] == f"I-{name[2:]}":
                        last += 1
                    start, end = shift + spans[t][0], shift + spans[last][1]
                    if accepted(name[2:], texts[k][start:end]) and not any(start < y and x < end for _, x, y in base[k]):
                        out[k].append((name[2:], start, end))
                t = last + 1
    return out


def _batches(lengths: list[int], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices of ascending lengths whose padded size stays under ``most``; a longer line goes alone."""
    a = 0
    for b in range(1, len(lengths) + 1):
        if b == len(lengths) or (b + 1 - a) * lengths[b] > most:
            yield a, b
            a = b


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1])))


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = part.column("text").to_pylist()
                base = [base_spans(t) if t else [] for t in texts]
                all_spans = [b + f for b, f in zip(base, found_spans([t or "" for t in texts], field, base), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(s) for s in all_spans])], names)

    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
    return run


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all), a row a row."""
    common.small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text).rlike("[0-9@]"), F.col(text)).alias("text"))
    return common.mapped(rows, _find(train()), schema)


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: -int(s[1])):
        text = f"{text[: int(a)]}[{kind}]{text[int(b) :]}"
    return text
