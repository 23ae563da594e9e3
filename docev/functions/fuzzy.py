"""Fuzzy similarity of names as Arrow-batched UDFs: no built-in expression has these ratios.

Pairs go through numpy many at a time: a pair's shorter name is one or more lanes of 64 bits, and every step takes
the next character of all pairs' other names. ``similar`` is the same of one pair, in plain Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by whole-row bit arithmetic."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        held = row & masks.get(c, 0)
        row = ((row + held) | (row - held)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common / (n + m)."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length of the longer, or a shorter
    window at either end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    held = set(short)
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        # A window that doesn't end, or begin at the front, with a shared character can't be the best.
        if (window[-1] if start < len(long) - n else window[0]) in held:
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


@lru_cache(100_000)
def similar(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 100.0 if a == b else max(ratio(a, b), partial(a, b))


#: Pairs whose lanes are held at once; their longest names decide how large that is.
BATCH = 4096


def _padded(names: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the names, a row each, and their lengths."""
    coded = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in names]
    lengths = np.array([len(c) for c in coded], np.int64)
    out = np.full((len(names), max(1, int(lengths.max(initial=0)))), fill, np.uint32)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.concatenate(coded) if len(coded) else []
    return out, lengths


def common_many(one: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The longest common subsequences of rows of code points. Padding differs between the two, so it never matches.
    A row's bits say where ``one`` isn't yet used; a sum's carry moves on through the lanes of a longer name."""
    n, width = one.shape
    lanes = -(-width // 64)
    rows = np.full((lanes, n), ~np.uint64(0), np.uint64)
    equal = np.zeros((n, lanes * 64), bool)
    for j in range(other.shape[1]):
        equal[:, :width] = one == other[:, j, None]
        masks = np.packbits(equal, axis=1, bitorder="little").view("<u8").T
        carry = np.zeros(n, np.uint64)
        for k in range(lanes):
            held = rows[k] & masks[k]
            total = rows[k] + held
            more = total + carry
            carry = ((total < rows[k]) | (more < total)).astype(np.uint64)
            rows[k] = more | (rows[k] & ~held)
    used = np.zeros(n, np.int64)
    for k in range(lanes):
        bits = np.clip(lengths - 64 * k, 0, 64)
        valid = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        used += np.bitwise_count(~rows[k] & valid)
    return used


def _windows(short: np.ndarray, n: np.ndarray, long: np.ndarray, m: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The best ratio of each shorter name with a window of the longer, where it beats ``best``. A window can't share more
    characters than it has of the shorter name's: the window with most of them is measured first, and then only those
    that could still be better."""
    count, width = long.shape
    known = (long[:, :, None] == short[:, None, :]).any(2)
    sums = np.concatenate([np.zeros((count, 1), np.int64), np.cumsum(known, axis=1)], axis=1)
    starts = np.arange(1 - int(n.max(initial=1)), width)[None, :]
    low, high = np.clip(starts, 0, m[:, None]), np.clip(starts + n[:, None], 0, m[:, None])
    there = (starts > -n[:, None]) & (starts < m[:, None])
    held = np.minimum(np.take_along_axis(sums, high, 1) - np.take_along_axis(sums, low, 1), n[:, None])
    bound = np.where(there, 200.0 * held / np.maximum(n[:, None] + high - low, 1), -1.0)

    def measure(who: np.ndarray, at: np.ndarray) -> None:
        for k in range(0, len(who), BATCH):
            w, a = who[k : k + BATCH], at[k : k + BATCH]
            span = np.arange(int(n[w].max()))[None, :] + low[w, a][:, None]
            cut = np.where(span < high[w, a][:, None], np.take_along_axis(long[w], np.minimum(span, width - 1), 1), np.uint32(0xFFFFFFFE))
            found = common_many(short[w], n[w], cut)
            np.maximum.at(best, w, 200.0 * found / (n[w] + high[w, a] - low[w, a]))

    first = bound.argmax(1)
    hopeful = np.flatnonzero(bound[np.arange(count), first] > best)
    measure(hopeful, first[hopeful])
    bound[np.arange(count), first] = -1.0
    measure(*np.nonzero(bound > best[:, None]))
    return best


def similar_many(one: list[str], other: list[str], whole: bool = True) -> np.ndarray:
    """``similar`` of many pairs; without ``whole`` only ``partial``, and 0 for empty names."""
    out = np.zeros(len(one))
    out[[k for k, (a, b) in enumerate(zip(one, other, strict=True)) if a and a == b]] = 100.0
    pairs = sorted(((a, b, k) if len(a) <= len(b) else (b, a, k) for k, (a, b) in enumerate(zip(one, other, strict=True)) if a and b and a != b), key=lambda p: (len(p[1]), len(p[0])))
    at = 0
    while at < len(pairs):
        end = at + 1
        while end < len(pairs) and end - at < BATCH and (end - at) * len(pairs[end][1]) ** 2 < 1 << 24:
            end += 1
        part, at = pairs[at:end], end
        (short, n), (long, m) = _padded([p[0] for p in part], 0xFFFFFFFF), _padded([p[1] for p in part], 0xFFFFFFFE)
        best = 200.0 * common_many(short, n, long) / (n + m) if whole else np.zeros(len(part))
        out[[p[2] for p in part]] = _windows(short, n, long, m, best)
    return out


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(similar_many([x or "" for x in a], [y or "" for y in b]), dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100 between two names, once normalised; 0 if either is empty."""
    return _similarity(text.normalize(a), text.normalize(b))


@F.pandas_udf(DoubleType())
def partial_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the best ratio of the shorter name, as it stands, with a window of the other; 0 if either is empty."""
    return pd.Series(similar_many([x or "" for x in a], [y or "" for y in b], whole=False), dtype="float64")
