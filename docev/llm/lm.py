"""Operator 2: language-model scoring by Stupid Backoff.

Count tables of n-grams up to ``order`` over all documents are partitioned by hash and joined to the
n-grams that each block of the corpus holds; the answers are looked up per n-gram and summed per
document. The relations are those of explode, group by, join and sum; rows travel packed by block and
partition (see ``blocks``), so a very frequent n-gram is one entry a block, and what is gathered grows
with the corpus's distinct n-grams. No n-gram is pruned. Each order is a round of its own, whose
shuffle is deleted before the next.

A model of the corpus holds every n-gram of the text that it scores, so a text is held out of its own
model: c'(x) is the count of x in all other rows. A word w after (u, v) scores ln(c'(u, v, w) / c'(u, v))
if c'(u, v, w) > 0; else ln(backoff * c'(v, w) / c'(v)) if c'(v, w) > 0; else ln(backoff^2 * c'(w) / N')
if c'(w) > 0, N' being the words of all other rows; else ln(backoff^3 / N), N being the words of all
rows. At a text's start only the orders that fit are tried. ``n_backoff`` sums the steps taken. Logs are
taken in millionths, rounded, so that sums are exact in any order.

Defined results: a text without words (null, empty) has n_words 0, n_backoff 0, score_micro 0 and mean
null; repeated rows are texts of their own, so each vouches for the other; null ids stay null; an empty
table gives no rows; extra columns are not read. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, common

BACKOFF = 0.4
ORDER = 3
#: Distinct words, and distinct longer n-grams, of a block to its words, for the number of partitions.
WORDS_A_WORD, GRAMS_A_WORD = 0.2, 0.8

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("score_micro", T.LongType())])


class Grams:
    """The n-grams of a block by the word that each ends at."""

    def __init__(self, block: blocks.Block, n: int):
        place = np.arange(len(block.codes)) - block.offsets[block.doc]
        #: The last words of the n-grams that lie in one document.
        self.at = np.flatnonzero(place >= n - 1)
        names = block.hashes[: max(0, len(block.codes) - n + 1)].copy()
        for k in range(1, n):
            names = common.mix64(names * common._MIX + block.hashes[k : k + len(names)])
        self.names = names[self.at - n + 1]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return common.unique_counts(self.names)


def _ask(n: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows(batches):
            block = blocks.Block(row)
            key, count = Grams(block, n).distinct()
            count = count.astype("<u4")
            yield from blocks.requests(block.name, blocks.split(key, parts), lambda a, b: blocks.pack_keys(key[a:b]) + count[a:b].tobytes())  # noqa: B023

    return run


def _join(_: int, payloads: list[bytes]) -> list[bytes | None]:
    """The count table of one partition joined to what each block asked, in the order asked."""
    sizes = [len(p) // 12 for p in payloads]
    key = np.concatenate([blocks.unpack_keys(p, s) for p, s in zip(payloads, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(p, "<u4", s, 8 * s) for p, s in zip(payloads, sizes, strict=True)])
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    totals = np.add.reduceat(count[order].astype(np.int64), first)
    joined = np.empty(len(key), np.int64)
    joined[order] = np.repeat(totals, np.diff(np.append(first, len(key))))
    wide = joined.max(initial=0) >= 1 << 32
    return [(b"\x08" if wide else b"\x04") + part.astype("<i8" if wide else "<u4").tobytes() for part in np.split(joined, np.cumsum(sizes)[:-1])]


def micro_log(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * 1e6).astype(np.int64)


def elsewhere(block: blocks.Block, n: int, parts: int, replies: list[dict]) -> np.ndarray:
    """For each word the count, in all other documents, of the n-gram that ends there; 0 where none fits."""
    grams = Grams(block, n)
    key = common.sorted_unique(grams.names)
    cuts = blocks.split(key, parts)
    counts = np.zeros(len(key), np.int64)
    for reply in replies:
        payload = reply["payload"]
        counts[cuts[reply["part"]] : cuts[reply["part"] + 1]] = np.frombuffer(payload, "<i8" if payload[0] == 8 else "<u4", offset=1)
    which = np.searchsorted(key, grams.names)
    mine = block.doc[grams.at] * max(1, len(key)) + which
    order = np.argsort(mine)
    ordered = mine[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(mine) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(mine)))
    own = np.empty(len(mine), np.int64)
    own[order] = np.repeat(times, times)
    out = np.zeros(len(block.codes), np.int64)
    out[grams.at] = counts[which] - own
    return out


def _score(parts: list[int], total: int, backoff: float):
    order = len(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows(batches):
            block = blocks.Block(row)
            place = np.arange(len(block.codes)) - block.offsets[block.doc]
            rest = [elsewhere(block, n, parts[n - 1], blocks.replies_of(row, n - 1)) for n in range(1, order + 1)]
            score, steps, open_ = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.ones(len(place), bool)
            factor = backoff ** np.arange(order + 1)
            for n in range(order, 0, -1):
                fits = open_ & (place >= n - 1)
                seen = np.flatnonzero(fits & (rest[n - 1] > 0))
                under = rest[n - 2][seen - 1] if n > 1 else total - block.lengths[block.doc[seen]]
                score[seen] = micro_log(factor[steps[seen]] * rest[n - 1][seen] / under)
                open_[seen] = False
                steps += fits & open_
            score[open_] = micro_log(factor[steps[open_]] / max(1, total))
            yield pa.RecordBatch.from_arrays([block.ids(), pa.array(block.lengths), pa.array(block.summed(steps)), pa.array(block.summed(score))], ["doc_id", "n_words", "n_backoff", "score_micro"])

    return run


def score(docs: DataFrame, stage: common.Stage, backoff: float = BACKOFF, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_backoff, score_micro (the sum of logs in millionths) and mean (a word's log)."""
    held = blocks.prepare(docs, stage, doc_id=doc_id, text=text)
    total = held.agg(F.sum("n_words")).first()[0] or 0
    parts = [blocks.parts_for(held, WORDS_A_WORD if n == 1 else GRAMS_A_WORD) for n in range(1, order + 1)]
    counts = [blocks.answered(common.mapped(held, _ask(n, parts[n - 1]), blocks.REQUEST), _join, stage, f"counts{n}") for n in range(1, order + 1)]
    scored = common.mapped(blocks.with_replies(held, *counts), _score(parts, total, backoff), RESULT)
    return scored.withColumn("mean", F.when(F.col("n_words") > 0, F.col("score_micro") / F.lit(1e6) / F.col("n_words")))
