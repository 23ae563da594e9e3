"""A corpus as blocks of word codes, and a keyed exchange between blocks and hash partitions.

``prepare`` reads the texts once and writes one row a block: about a million words as codes into the
block's own vocabulary. Operators that need a statistic of every n-gram of the corpus send, from each
block, its distinct keys packed by hash partition; one partition joins what all blocks ask and
answers each. A key that every document holds is so one entry a block, not one a document, and no
partition grows with a hot key. Only rows of the size of a block or of a block's share of a partition
are shuffled, and every step reads a written table, so a lost executor repeats its own tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_WORDS = 1_000_000
#: Keys to a hash partition, on average.
PART_KEYS = 2_000_000

BLOCK = T.StructType([T.StructField("block", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("payload", T.BinaryType())])
REQUEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.StringType()), T.StructField("payload", T.BinaryType())])
_REQUEST = pa.schema([("part", pa.int32()), ("block", pa.string()), ("payload", pa.binary())])
_BLOCK = pa.schema([("block", pa.string()), ("n_words", pa.int64()), ("payload", pa.binary())])
_ARRAYS = pa.schema([("doc_ids", pa.binary()), ("nulls", pa.binary()), ("offsets", pa.binary()), ("codes", pa.binary()), ("words", pa.binary())])


def _packed(ids: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
    """One block: its arrays as a compressed Arrow stream, so that a shuffle moves few bytes. Codes go
    by falling frequency, as planes of bytes."""
    codes, distinct, offsets = common.coded_words(pa.concat_arrays(texts))
    order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order), dtype=np.uint32)
    planes = np.ascontiguousarray(place[codes].view(np.uint8).reshape(-1, 4).T)
    words = " ".join(distinct.take(pa.array(order)).to_pylist()).encode()
    doc_ids = pa.concat_arrays(ids)
    nulls = np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False))
    arrays = [doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), nulls.tobytes(), offsets.astype("<i8").tobytes(), planes.tobytes(), words]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARRAYS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in arrays], schema=_ARRAYS))
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([len(codes)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_BLOCK)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            ids.append(part.column("doc_id"))
            texts.append(part.column("text").cast(pa.large_string()))
            size += texts[-1].nbytes // 6
            if size >= BLOCK_WORDS:
                yield _packed(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _packed(ids, texts)


def prepare(docs: DataFrame, stage: common.Stage, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage.table("blocks", common.mapped(rows, _prepare, BLOCK), codec="none")


class Block:
    """A block's arrays."""

    def __init__(self, row: dict):
        self.name = row["block"]
        held = pa.ipc.open_stream(row["payload"]).read_next_batch().to_pylist()[0]
        self.doc_ids = np.frombuffer(held["doc_ids"], "<i8")
        #: Which documents have no id; their doc_ids are 0.
        self.nulls = np.unpackbits(np.frombuffer(held["nulls"], np.uint8), count=len(self.doc_ids)).astype(bool)
        self.offsets = np.frombuffer(held["offsets"], "<i8")
        planes = np.frombuffer(held["codes"], np.uint8).reshape(4, -1)
        self.codes = np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)
        self.words = held["words"].decode().split(" ") if held["words"] else []
        self.vocabulary = common.hash_words(pa.array(self.words, pa.string()))
        self.hashes = self.vocabulary[self.codes]
        self.lengths = np.diff(self.offsets)
        #: The index of each word's document.
        self.doc = np.repeat(np.arange(len(self.doc_ids)), self.lengths)

    def ids(self) -> pa.Array:
        return pa.array(self.doc_ids, mask=self.nulls)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each document."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.offsets])


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; a batch's memory is the only one held."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def parts_for(blocks: DataFrame, keys_a_word: float) -> int:
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(1, int(-(-total * keys_a_word // PART_KEYS)))


def split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and bounds that deal sorted 64-bit keys to partitions by range; keys are hashes."""
    step = (1 << 64) // parts
    bounds = np.array([min((1 << 64) - 1, k * step) for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds, "left"), [len(keys)]])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as planes of the bytes of their differences, which compress where keys are dense."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(packed: bytes, n: int, at: int = 0) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, 8 * n, at).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def requests(name: str, cuts: np.ndarray, pack: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of REQUEST for one block: pack(a, b) gives the payload of the sorted keys a to b."""
    found = [(p, pack(a, b)) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([name] * len(found)), pa.array([b for _, b in found], pa.binary())], schema=_REQUEST)


def answered(asked: DataFrame, answer: Callable[[int, list[bytes]], list[bytes | None]], stage: common.Stage, name: str) -> DataFrame:
    """REQUEST rows that answer ``asked``. ``answer`` gets a partition's number and all its payloads and
    returns one reply for each, None for none."""

    def run(table: pa.Table) -> pa.Table:
        replies = answer(table.column("part")[0].as_py(), table.column("payload").to_pylist())
        out = pa.Table.from_arrays([table.column("part"), table.column("block"), pa.chunked_array([pa.array(replies, pa.binary())])], schema=_REQUEST)
        return out.filter(out.column("payload").is_valid())

    return stage.table(name, asked.groupBy("part").applyInArrow(common.trimmed(run), REQUEST))


def with_replies(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks beside ``replies``: what each of the ``answers`` holds for it, as (level, part, payload) in order."""
    tagged = [a.select("block", F.struct(F.lit(k).alias("level"), "part", "payload").alias("r")) for k, a in enumerate(answers)]
    held = reduce(DataFrame.unionByName, tagged).groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("replies"))
    return blocks.join(held.hint("shuffle_hash"), "block", "left")


def replies_of(row: dict, level: int) -> list[dict]:
    return [r for r in row["replies"] or [] if r["level"] == level]
