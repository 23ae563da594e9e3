"""Operator 10: benchmark decontamination by latent semantic retrieval.

Texts become sequences of terms of the benchmark's vocabulary (lower case, without marks; all other
words are gaps that keep their place). Passages of ``PASSAGE`` words, half overlapping, are weighted by
TF-IDF with document frequencies over all blocks of the corpus, and projected on the right singular
vectors of a randomised SVD. A passage and an item whose cosine reaches ``COSINE`` are a candidate, and
an item is found in a text if the longest common subsequence of the item and the words around the
passage holds ``LCS`` of the item's terms and, as a check of its answer, ``ANSWER`` of its rarest terms
are there: paraphrases that keep the order of most words are found, chance runs of common words not. Items
of at most ``SHORT`` terms would be lost among a passage's other words, and meet shorter passages too.

The SVD's range is found distributedly, A'(AX) summed over tasks, twice, over all these passages of all texts and
the benchmark; frequencies, search and checks cover all texts too. The benchmark is a query set, taken in blocks of
``BLOCK_ITEMS``.

Defined results: null or empty texts hold nothing; items without a term are never found; repeated rows
give their pairs each; a null doc_id stays null; empty tables give no rows; an item of few terms is
held to the same shares. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PASSAGE = 64
STEP = PASSAGE // 2
#: Items of at most ``SHORT`` terms also meet passages of twice ``FINE`` words, in which they weigh enough.
SHORT, FINE = 12, 8
RANK, OVERSAMPLE = 128, 16
COSINE = 0.5
LCS, ANSWER = 0.7, 0.5
#: Terms that the range finder takes as columns of a dense matrix.
DENSE_TERMS = 256
BLOCK_ITEMS = 2_000
MARKS = ".,;:!?|*#$%&()[]{}<>\"'-"
#: Words projected at a time.
CHUNK_WORDS = 40_000


def terms_of(key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", key), T.StructField("terms", T.BinaryType())])


def found_of(key: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", key), T.StructField("item_id", T.LongType()), T.StructField("matched", T.LongType()),
        T.StructField("item_terms", T.LongType()), T.StructField("cosine", T.DoubleType()),
    ])


def normal(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)


class Items:
    """A block of the benchmark: its vocabulary, and each item's terms as numbers from 1."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        codes, distinct, offsets = common.coded_words(pa.array(texts, pa.large_string()))
        plain = normal(distinct)
        self.vocabulary = pc.unique(plain.filter(pc.not_equal(plain, "")))
        self.type = np.dtype("<u2") if len(self.vocabulary) < 1 << 16 else np.dtype("<u4")
        terms = self.terms(distinct)[codes]
        self.ids, self.of = [], []
        for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            of = terms[a:b]
            if of.any():
                self.ids.append(i)
                self.of.append(of[of > 0].astype(np.int64))
        self.idf = self.basis = self.vectors = None

    def terms(self, distinct: pa.Array) -> np.ndarray:
        """The term of each distinct word; 0: none."""
        found = pc.index_in(normal(distinct), value_set=self.vocabulary)
        return pc.fill_null(pc.add(found, 1), 0).to_numpy().astype(self.type)

    def weigh(self, frequency: np.ndarray, blocks: int) -> None:
        self.idf = np.concatenate([[0], np.log((blocks + 1) / (frequency + 1)) + 0.1]).astype(np.float32)
        self.masks, self.rare = [], []
        for of in self.of:
            masks: dict[int, int] = {}
            for k, t in enumerate(of.tolist()):
                masks[t] = masks.get(t, 0) | 1 << k
            kinds = np.unique(of)
            self.masks.append(masks)
            self.rare.append(frozenset(kinds[np.argsort(-self.idf[kinds], kind="stable")][: -(-len(kinds) // 4)].tolist()))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Items as rows of weighted terms: pieces of at most a passage, and the item of each."""
        rows, item = [], []
        for k, of in enumerate(self.of):
            for a in range(0, len(of), PASSAGE):
                row = np.bincount(of[a : a + PASSAGE], minlength=len(self.idf)) * self.idf
                rows.append(row / max(np.linalg.norm(row), 1e-9))
                item.append(k)
        return np.array(rows, np.float32).reshape(len(rows), len(self.idf)), np.array(item, np.int64)

    def settle(self, basis: np.ndarray) -> None:
        """Take the basis and project the items."""
        rows, self.item = self.pieces()
        self.basis = basis
        self.vectors = _unit(rows @ basis)
        short = np.array([k for k, i in enumerate(self.item) if len(self.of[i]) <= SHORT], np.int64)
        self.scales = [(STEP, np.arange(len(self.item)))] + ([(FINE, short)] if len(short) else [])
        self.weighted = self.idf[:, None] * basis


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _reduced(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distinct, offsets = common.coded_words(batch.column("text"))
            terms = items.terms(distinct)[codes]
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * items.type.itemsize), pa.py_buffer(terms)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data.cast(pa.binary())], ["doc_id", "terms"])

    return run


def _texts(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int | bytes | None, np.ndarray]]:
    for batch in batches:
        for doc_id, terms in zip(batch.column("doc_id").to_pylist(), batch.column("terms"), strict=True):
            yield doc_id, np.frombuffer(terms.as_buffer(), kind).astype(np.int64)


def _blocks(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """About ``CHUNK_WORDS`` terms of a batch's texts at a time, the block of each, and the last block of the passage that
    each block begins: the next one, itself if it is its text's only one, none (-1) at the end of a text."""
    held = [np.frombuffer(t.as_buffer(), kind) for t in batch.column("terms")]
    lengths = np.array([len(t) for t in held], np.int64)
    terms = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    blocks = -(-lengths // STEP)
    total = int(blocks.sum())
    ends = np.cumsum(blocks)
    last = np.arange(1, total + 1)
    last[ends[blocks > 0] - 1] = -1
    last[ends[blocks == 1] - 1] = ends[blocks == 1] - 1
    starts = np.repeat(np.cumsum(lengths) - lengths, blocks) + common.ranges(np.zeros(len(blocks), np.int64), blocks) * STEP
    starts = np.append(starts, len(terms))
    block = np.repeat(np.arange(total), np.diff(starts))
    width = max(1, CHUNK_WORDS // STEP)
    for a in range(0, total, width):
        b = min(a + width, total)
        end = b + int(last[b - 1] == b)  # the other half of the last passage
        begun = np.append(last[a:b], np.full(end - b, -1))
        yield terms[starts[a] : starts[end]], block[starts[a] : starts[end]] - a, np.where(begun < 0, -1, begun - a)


def _frequencies(kind: np.dtype, size: int):
    """(term, blocks of STEP words that have it); term 0 counts the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, terms in _texts(batches, kind):
            block = np.arange(len(terms)) // STEP
            keys = common.sorted_unique((block * size + terms).astype(np.uint64))
            total += np.bincount((keys % np.uint64(size)).astype(np.int64), minlength=size)
            total[0] += -(-len(terms) // STEP) - np.count_nonzero(keys % np.uint64(size) == 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    return run


def blocks_of(terms: np.ndarray, weighted: np.ndarray, step: int = STEP) -> np.ndarray:
    """The sum of the rows of ``weighted`` over each block of ``step`` words of a text."""
    n = -(-len(terms) // step)
    out = np.zeros((n, weighted.shape[1]), np.float32)
    width = CHUNK_WORDS // step
    for a in range(0, n, width):
        part = terms[a * step : (a + width) * step]
        out[a : a + width] = np.add.reduceat(weighted[part], np.arange(0, len(part), step))
    return out


def passages_of(blocks: np.ndarray) -> np.ndarray:
    """Half-overlapping passages of two blocks; the last block alone begins none but its own."""
    return blocks[:-1] + blocks[1:] if len(blocks) > 1 else blocks


def _gathered(kind: np.dtype, idf: np.ndarray, against: np.ndarray):
    """A'(A X) over the rows of a task, packed by segments of terms; A: unit passages, the same that the search projects.
    Terms are multiplied by block, passages are sums of two. The commonest terms, which are most of a passage, go through
    a matrix product, the others one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(against.shape, np.float64)
        most = np.argsort(idf[1:], kind="stable")[:DENSE_TERMS] + 1
        slot = np.full(len(idf), -1)
        slot[most] = np.arange(len(most))
        for batch in batches:
            for terms, block, last in _blocks(batch, kind):
                there = terms > 0
                keys, counts = common.unique_counts((block[there] * len(idf) + terms[there]).astype(np.uint64))
                if not len(keys):
                    continue
                of, term = (x.astype(np.int64) for x in np.divmod(keys, np.uint64(len(idf))))
                weights = counts.astype(np.float32) * idf[term]
                begins = np.flatnonzero(last > np.arange(len(last)))
                alone = np.flatnonzero(last == np.arange(len(last)))
                square = np.bincount(of, weights**2, minlength=len(last))
                after = np.minimum(np.searchsorted(keys, keys + np.uint64(len(idf))), len(keys) - 1)
                both = keys[after] == keys + np.uint64(len(idf))  # the term stands in the next block too
                shared = np.bincount(of[both], weights[both] * weights[after[both]], minlength=len(last))
                few = slot[term] < 0
                dense = np.zeros((len(last), len(most)), np.float32)
                dense[of[~few], slot[term[~few]]] = weights[~few]
                product = dense @ against[most]
                term, of, weights = term[few], of[few], weights[few, None]
                if len(term):
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    product[of[first]] += np.add.reduceat(against[term] * weights, first)
                image = np.zeros_like(product)
                length = square[begins] + square[begins + 1] + 2 * shared[begins]
                of_two = (product[begins] + product[begins + 1]) / np.maximum(length, 1e-18).astype(np.float32)[:, None]
                image[begins] += of_two
                image[begins + 1] += of_two
                image[alone] += product[alone] / np.maximum(square[alone], 1e-18).astype(np.float32)[:, None]
                if len(term):
                    order = np.argsort(term, kind="stable")
                    term, of, weights = term[order], of[order], weights[order]
                    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                    total[term[first]] += np.add.reduceat(image[of] * weights, first)
                total[most] += dense.T @ image
        if total.any():
            for s in range(0, len(total), 512):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([total[s : s + 512].tobytes()], pa.binary())], ["segment", "sums"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table([pa.array([table.column("segment")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "sums"])


def singular(terms: DataFrame, items: Items, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors of all passages of all texts and of the items, by a randomised range finder
    with one power step. Items weigh together as much as the texts, so their directions are kept.
    What comes to the driver is one row a term of the benchmark's block."""
    schema = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("sums", T.BinaryType())])
    rows, _ = items.pieces()
    size = len(items.idf)
    width = min(size, rank + OVERSAMPLE)

    def gram(x: np.ndarray) -> np.ndarray:
        partial = common.mapped(terms, _gathered(items.type, items.idf, x.astype(np.float32)), schema)
        out = np.zeros(x.shape)
        for row in partial.groupBy("segment").applyInArrow(_summed, schema).collect():
            part = np.frombuffer(row["sums"], np.float64).reshape(-1, x.shape[1])
            out[row["segment"] : row["segment"] + len(part)] = part
        own = rows.T @ (rows @ x)
        return out + own * max(1.0, np.linalg.norm(out) / max(np.linalg.norm(own), 1e-9))

    basis, _ = np.linalg.qr(gram(np.random.default_rng(seed).standard_normal((size, width))))
    image = gram(basis)
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    return (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """The length of the longest common subsequence, by whole-row bit arithmetic."""
    full = (1 << n) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask:
            held = row & mask
            row = ((row + held) | (row - held)) & full
    return n - row.bit_count()


def _near(terms: np.ndarray, items: Items, cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """Candidates: where a passage begins, the words of half of it, the item and the cosine."""
    for a in range(0, -(-len(terms) // STEP), 2000):  # a long text is projected a part at a time
        part = terms[a * STEP : (a + 2001) * STEP]
        for step, pieces in items.scales:
            near = _unit(passages_of(blocks_of(part, items.weighted, step))) @ items.vectors[pieces].T
            for p, q in zip(*np.nonzero(near >= cosine), strict=True):
                yield a * STEP + int(p) * step, step, int(items.item[pieces[q]]), float(near[p, q])


def matches(terms: np.ndarray, items: Items, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER) -> dict[int, tuple[int, float]]:
    """Items found in a text: the longest subsequence and the highest cosine of its candidates."""
    found: dict[int, tuple[int, float]] = {}
    if not terms.any():
        return found
    for start, step, item, near in _near(terms, items, cosine):
        size = len(items.of[item])
        pad = max(step, size)
        around = terms[max(0, start - pad) : start + 2 * step + pad].tolist()
        rare = items.rare[item]
        if len(rare.intersection(around)) < answer * len(rare):
            continue
        matched = subsequence(items.masks[item], size, around)
        if matched >= lcs * size and matched >= found.get(item, (0, 0.0))[0]:
            found[item] = (matched, max(near, found.get(item, (0, 0.0))[1]))
    return found


def _search(items: Items, cosine: float, lcs: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc_id, items.ids[k], m, len(items.of[k]), c) for doc_id, terms in _texts([batch], items.type) for k, (m, c) in sorted(matches(terms, items, cosine, lcs, answer).items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "matched", "item_terms", "cosine"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, stage: common.Stage, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER,
         doc_id: str = "doc_id", text: str = "text", key: T.DataType = T.LongType()) -> DataFrame:  # noqa: B008
    """doc_id, item_id, matched, item_terms and cosine for every text and item found in it; ``key`` is
    the type of the ids, where something else than the document's number tells texts apart."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(doc_id).cast(key).alias("doc_id"), F.col(text).alias("text"))
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    parts = max(1, -(-wanted.count() // BLOCK_ITEMS))
    out = spark.createDataFrame([], found_of(key))
    for k in range(parts):
        held = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in held], [r["text"] for r in held])
        if not items.ids:
            continue
        terms = stage.table(f"terms{k}", common.mapped(rows, _reduced(items), terms_of(key)))
        size = len(items.vocabulary) + 1
        counted = common.mapped(terms, _frequencies(items.type, size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(size)
        for r in counted:
            frequency[r["term"]] = r["n"]
        items.weigh(frequency[1:], int(frequency[0]))
        items.settle(singular(terms, items))
        found = common.mapped(terms, _search(items, cosine, lcs, answer), found_of(key))
        out = found if parts == 1 else out.unionByName(found)
    return out
