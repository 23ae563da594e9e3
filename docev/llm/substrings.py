"""Operator 8: substring deduplication by recompression.

Texts are rewritten in rounds. A round first collapses runs of equal symbols, then a coin per symbol,
drawn from its name, splits the alphabet in two, and every (left, right) pair of neighbours becomes one
symbol. Its name is dealt by Spark: each block sends its distinct pairs to hash partitions, where equal
pairs of all documents get one global name, and pairs of one document only get none. A run's length is
left out of its name, as a window that cuts a run can't know it; lengths are verified with the words.

A symbol carries the words its making depends on, so any equal run of words that holds those words has
the same symbol inside. Symbols without a name, and neighbouring high-level symbols found in one
document only, rule out all windows of 13 words that hold them and are not paired further. The windows
left are verified by 128 bits of all their words, with the smallest doc_id that holds each, and the
covered words are removed. Pairs and windows are asked for by block (see ``blocks``): a passage that a
third of all documents share is one entry a block.

Defined results: a null text has no words; a text under 13 words keeps all; a null doc_id counts as
larger than any other, 2^63 - 1 included; rows with the same doc_id don't remove one another; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blocks, common

WINDOW = 13
ROUNDS = 2
#: Distinct pairs of a block to its words in each round and at the end, and candidate windows, for the
#: number of partitions.
PAIRS_A_WORD, WINDOWS_A_WORD = (0.25, 0.25, 0.5), 0.3
LAST_ID = np.int64(2**63 - 1)

RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()),
])


class Symbols:
    """A block's symbols in order: name, document, and the first and last word depended on. ``plain``
    tells the symbols that can be paired. At a document's end a dependence goes past it, so that it fits
    in no window."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, plain: np.ndarray):
        self.name, self.doc, self.lo, self.hi, self.plain = name, doc, lo, hi, plain

    @classmethod
    def of_words(cls, names: np.ndarray, doc: np.ndarray) -> Symbols:
        at = np.arange(len(names), dtype=np.int64)
        return cls(names, doc, at, at, np.ones(len(names), bool))

    def paired(self, level: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
        """The next symbols, whose pairs are still to be named; the places of the pairs that a window can
        hold, and their keys."""
        n = len(self.name)
        if not n:
            return self, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        together = self.doc[1:] == self.doc[:-1]
        again = together & (self.name[1:] == self.name[:-1]) & self.plain[1:] & self.plain[:-1]
        first = np.flatnonzero(~np.concatenate([[False], again]))
        last = np.append(first[1:], n) - 1
        # What lies left of a run's end, or right of its beginning, isn't needed to know the symbol there.
        x, doc, plain = self.name[first], self.doc[first], self.plain[first]
        low, high, past = self.lo[last], self.hi[first], self.hi[last]
        together = doc[1:] == doc[:-1]
        right = (common.mix64(x + np.uint64(level + 1)) & np.uint64(1)).astype(bool) & plain
        merged = ~right[:-1] & right[1:] & together & plain[:-1]
        before = np.concatenate([[np.int64(-1)], np.where(together, low[:-1], self.lo[first][1:] - 1)])
        after = np.concatenate([np.where(together, high[1:], past[:-1] + 1), past[-1:] + 1])
        alone_low, alone_high = np.where(right, before, low), np.where(right, high, after)
        starts = np.flatnonzero(~np.concatenate([[False], merged]))
        pair = np.concatenate([merged, [False]])[starts]
        second = starts + pair
        lo, hi = np.where(pair, low[starts], alone_low[starts]), np.where(pair, high[second], alone_high[starts])
        out = Symbols(x[starts], doc[starts], lo, hi, plain[starts] & ~pair)
        at = np.flatnonzero(pair & (hi - lo < WINDOW))
        return out, at, _key(x[starts[at]], x[second[at]], level)

    def neighbours(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of neighbouring symbols that a window can hold, and their keys."""
        fit = np.flatnonzero((self.doc[1:] == self.doc[:-1]) & self.plain[1:] & self.plain[:-1] & (self.hi[1:] - self.lo[:-1] < WINDOW))
        return fit, _key(self.name[fit], self.name[fit + 1], level)


def _key(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return common.mix64(a * common._MIX + common.mix64(b + np.uint64(level)))


class Trace:
    """A block rewritten as far as ``replies`` name its pairs; then ``key``, ``doc``, ``lo`` and ``hi`` of
    what is to be asked next, and the dependences (``alone``) of what one document only has."""

    def __init__(self, block: blocks.Block, parts: list[int], replies: list[list[dict]], rounds: int = ROUNDS):
        symbols, self.alone = Symbols.of_words(block.hashes, block.doc), []
        for level in range(rounds):
            symbols, at, self.key = symbols.paired(level)
            self.doc, self.lo, self.hi = symbols.doc[at], symbols.lo[at], symbols.hi[at]
            if level == len(replies):
                return
            name = self._names(parts[level], replies[level], level)
            symbols.name[at], symbols.plain[at] = name, name > 0
        at, self.key = symbols.neighbours(rounds)
        self.doc, self.lo, self.hi = symbols.doc[at], symbols.lo[at], symbols.hi[at + 1]
        if len(replies) > rounds:
            self._names(parts[rounds], replies[rounds], rounds)

    def _names(self, parts: int, replies: list[dict], level: int) -> np.ndarray:
        distinct = common.sorted_unique(self.key)
        cuts = blocks.split(distinct, parts)
        names = np.zeros(len(distinct), np.uint64)
        for reply in replies:
            a, b = int(cuts[reply["part"]]), int(cuts[reply["part"] + 1])
            ranks = _unpack_ranks(reply["payload"], b - a)
            names[a:b] = np.where(ranks, np.uint64((level + 1) << 60 | reply["part"] << 32) | ranks, np.uint64(0))
        found = names[np.searchsorted(distinct, self.key)] if len(distinct) else names
        self.alone.append((self.lo[found == 0], self.hi[found == 0]))
        return found

    def windows(self, block: blocks.Block) -> np.ndarray:
        """Starts of the windows that hold nothing that one document only has."""
        ended = np.zeros(len(block.codes) + 1, np.int32)
        for lo, hi in self.alone:
            np.add.at(ended, np.maximum(hi - WINDOW + 1, 0), 1)
            np.add.at(ended, lo + 1, -1)
        return np.flatnonzero(_starts(block) & (np.cumsum(ended[:-1]) == 0))


def _trace(row: dict, parts: list[int], levels: int) -> tuple[blocks.Block, Trace]:
    block = blocks.Block(row)
    return block, Trace(block, parts, [blocks.replies_of(row, k) for k in range(levels)])


def _grouped(block: blocks.Block, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents in groups that begin at ``first``: the smallest id, whether there is one, and whether
    the documents differ in id."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    null = block.nulls[doc]
    ids = np.where(null, LAST_ID, block.doc_ids[doc])
    least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    some, every = np.logical_or.reduceat(~null, first), np.logical_and.reduceat(~null, first)
    return least, some, (least != most) | (some & ~every)


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])]))


def _ask_names(parts: list[int], level: int):
    """Distinct keys of a block with 1 where two of its documents have the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows(batches):
            block, trace = _trace(row, parts, level)
            order = np.argsort(trace.key)
            key, doc = trace.key[order], trace.doc[order]
            first = _firsts(key)
            key, many = key[first], _grouped(block, doc, first)[2].astype(np.uint8)
            yield from blocks.requests(block.name, blocks.split(key, parts[level]), lambda a, b: blocks.pack_keys(key[a:b]) + many[a:b].tobytes())  # noqa: B023

    return run


def _pack_ranks(ranks: np.ndarray) -> bytes:
    """A bit for each rank that isn't 0, then the differences of those, as planes of bytes."""
    named = ranks > 0
    steps = np.diff(ranks[named], prepend=0).astype("<u4")
    return np.packbits(named).tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack_ranks(packed: bytes, n: int) -> np.ndarray:
    named = np.unpackbits(np.frombuffer(packed, np.uint8, -(-n // 8)), count=n).astype(bool)
    planes = np.frombuffer(packed, np.uint8, offset=-(-n // 8)).reshape(4, -1)
    out = np.zeros(n, np.uint64)
    out[named] = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint64)
    return out


def _name(_: int, payloads: list[bytes]) -> list[bytes | None]:
    """For each block the names of its keys in the order asked: the rank, from 1, of the key among those
    that two documents have; 0 for others."""
    sizes = [len(p) // 9 for p in payloads]
    keys = np.concatenate([blocks.unpack_keys(p, s) for p, s in zip(payloads, sizes, strict=True)])
    flags = np.concatenate([np.frombuffer(p, np.uint8, s, 8 * s) for p, s in zip(payloads, sizes, strict=True)])
    # Equal ids, or null ones, in two blocks count as two documents: they only add windows to verify.
    ordered = np.sort(keys)
    shared = common.sorted_unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], keys[flags > 0]]))
    place = np.searchsorted(shared, keys)
    held = np.append(shared, np.uint64(0))[place] == keys
    ranks = np.where(held & (place < len(shared)), place + 1, 0)
    return [_pack_ranks(part) for part in np.split(ranks, np.cumsum(sizes)[:-1])]


def _window_names(block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window's words, as two independent hashes."""
    other = common.hash_words(pa.array(block.words, pa.string()), 1)
    return common.rolled(block.hashes, WINDOW), common.rolled(other[block.codes], WINDOW)


def _starts(block: blocks.Block) -> np.ndarray:
    """Whether a window starts at each word and stays in its document."""
    ends = np.repeat(block.offsets[1:], block.lengths)
    return np.arange(len(block.codes)) + WINDOW <= ends


def _ask_windows(parts: list[int], window_parts: int):
    """Distinct candidate windows of a block with the smallest doc_id, and whether there are others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows(batches):
            block, trace = _trace(row, parts, len(parts))
            at = trace.windows(block)
            if not len(at):
                continue
            one, two = (name[at] for name in _window_names(block))
            order = np.lexsort((two, one))
            one, two, doc = one[order], two[order], block.doc[at][order]
            first = _firsts(one, two)
            least, some, many = _grouped(block, doc, first)
            one, two, least = one[first], two[first].astype("<u8"), least.astype("<i8")
            flags = many.astype(np.uint8) | some.astype(np.uint8) << 1
            yield from blocks.requests(block.name, blocks.split(one, window_parts), lambda a, b: blocks.pack_keys(one[a:b]) + two[a:b].tobytes() + least[a:b].tobytes() + flags[a:b].tobytes())  # noqa: B023

    return run


def _smallest(_: int, payloads: list[bytes]) -> list[bytes | None]:
    """For each block the windows that a smaller doc_id than some of its own has: names and that id."""
    sizes = [len(p) // 25 for p in payloads]
    column = lambda kind, at: np.concatenate([np.frombuffer(p, kind, s, at * s) for p, s in zip(payloads, sizes, strict=True)])
    one = np.concatenate([blocks.unpack_keys(p, s) for p, s in zip(payloads, sizes, strict=True)])
    two, least, flags = column("<u8", 8), column("<i8", 16), column(np.uint8, 24)
    order = np.lexsort((two, one))
    first = _firsts(one[order], two[order])
    times = np.diff(np.append(first, len(one)))
    smallest, some = np.empty_like(least), np.empty(len(one), bool)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], first), times)
    some[order] = np.repeat(np.logical_or.reduceat((flags[order] & 2) > 0, first), times)
    told = some & (((flags & 1) > 0) | (smallest < least) | ((flags & 2) == 0))
    cuts = np.cumsum(sizes)[:-1]
    parts = (np.split(x, cuts) for x in (one, two, smallest, told))
    return [o[t].tobytes() + w[t].tobytes() + s[t].tobytes() if t.any() else None for o, w, s, t in zip(*parts, strict=True)]


def removed(block: blocks.Block, replies: list[dict]) -> np.ndarray:
    """Whether each word is covered by a window that a smaller doc_id has."""
    size = len(block.codes)
    if not replies:
        return np.zeros(size, bool)
    counts = [len(r["payload"]) // 24 for r in replies]
    column = lambda kind, at: np.concatenate([np.frombuffer(r["payload"], kind, n, at * n) for r, n in zip(replies, counts, strict=True)])
    one, two, smallest = column("<u8", 0), column("<u8", 8), column("<i8", 16)  # in order, as partitions are
    at = np.flatnonzero(_starts(block))
    own, other = (name[at] for name in _window_names(block))
    place = np.searchsorted(one, own)
    hit = np.zeros(len(at), bool)
    doc = block.doc[at]
    for _ in range(int(np.unique(one, return_counts=True)[1].max())):  # more than once only where 64 bits collide
        held = np.minimum(place, len(one) - 1)
        hit |= (place < len(one)) & (one[held] == own) & (two[held] == other) & (block.nulls[doc] | (smallest[held] < block.doc_ids[doc]))
        place += 1
    change = np.zeros(size + 1, np.int32)
    change[at[hit]] += 1
    np.add.at(change, at[hit] + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows(batches):
            block = blocks.Block(row)
            gone = removed(block, blocks.replies_of(row, 0))
            words = block.words
            codes = block.codes[~gone].tolist()
            n_gone = np.concatenate([[0], np.cumsum(gone)])[block.offsets]
            lost = np.diff(n_gone)
            cuts = (block.offsets - n_gone).tolist()
            kept = [" ".join(map(words.__getitem__, codes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                block.ids(), pa.array(block.lengths), pa.array(lost),
                pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept]), pa.array(kept if with_text else [None] * len(kept), pa.string()),
            ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, stage: common.Stage, with_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words joined by a space) per row of ``docs``."""
    held = blocks.prepare(docs, stage, doc_id=doc_id, text=text)
    parts, window_parts = [blocks.parts_for(held, share) for share in PAIRS_A_WORD], blocks.parts_for(held, WINDOWS_A_WORD)
    named: list[DataFrame] = []
    for level in range(ROUNDS + 1):
        known = blocks.with_replies(held, *named) if named else held
        named.append(blocks.answered(common.mapped(known, _ask_names(parts, level), blocks.REQUEST), _name, stage, f"names{level}"))
    asked = common.mapped(blocks.with_replies(held, *named), _ask_windows(parts, window_parts), blocks.REQUEST)
    windows = blocks.answered(asked, _smallest, stage, "windows")
    stage.drop(*(f"names{level}" for level in range(ROUNDS + 1)))
    return common.mapped(blocks.with_replies(held, windows), _finish(with_text), RESULT)
