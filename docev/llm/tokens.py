"""Operator 7: token-id output in a binary format with frequency-ranked ids.

Texts are encoded with a public tokenizer and written; ids are counted over all of them and ranked by
falling frequency, equal counts by id. Texts are then dealt to buckets by quantiles of doc_id, sorted,
and written as chunks that code each id's rank in 1 to 4 bytes, whose lengths stand in separate control
bytes, 2 bits a value. Decoding is numpy table lookup. A chunk is one row of a Parquet table in the
shared folder, and the rank table is one beside it, so that Spark's commit protocol covers lost
executors and any store that Spark can write will do.

The tokenizer drops white space, so a text's ids are those of its words one after another; each batch
encodes its distinct words only. Tokenizers that keep white space are encoded text by text.

Defined results: a null or empty text has only the end id; documents go by ascending doc_id, null
first, equal ids by their token bytes; repeated rows are each written; an empty table writes no chunk
and reads back as no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common

END_ID = 1
#: Characters of text to a bucket, and tokens to a chunk: what one task holds at a time.
BUCKET_CHARS = 5_000_000
CHUNK_TOKENS = 1_000_000
#: More buckets would make the quantiles themselves large. Beyond so many (100 GB of characters) buckets
#: grow with the corpus; a bucket is sorted with spill and written a chunk at a time, so memory doesn't.
MOST_BUCKETS = 20_000
#: Lower-cased words whose ids a worker remembers between batches.
CACHED_WORDS = 500_000
#: A word of Latin letters, lower-cased, and the marks after it, which are a piece of their own for a
#: tokenizer that splits letters from marks. Here lower-casing and composing commute. Not among the
#: marks is the apostrophe, which begins contractions.
PLAIN = r"^(?P<head>[a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u012f]+)(?P<tail>[.,;:!?|*#$%&()\x22-]*)$".encode().decode("unicode_escape")

TOKENISED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
CHUNK = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.BinaryType()), T.StructField("null_ids", T.LongType()), T.StructField("lengths", T.BinaryType()),
    T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType()),
])
DECODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])

#: The four byte lengths that a control byte stands for.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    lengths = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    shown = np.arange(4, dtype=np.uint8) <= lengths[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[shown].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    held = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = held[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if len(longer):
            ranks[longer] |= held[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


class WordEncoder:
    """Ids of words by a tokenizer file, with a bounded memory of words seen before.

    A word of Latin letters and marks is two pieces, its letters in lower case and its marks; letters
    are remembered, so that a word costs one encoding however it is written. Any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        normalizer = spec.get("normalizer") or {}
        steps = [s.get("type") for s in normalizer.get("normalizers", [normalizer])]
        #: A lower-casing word tokenizer that collapses white space treats each word alone.
        self.by_word = "Replace" in steps and "Lowercase" in steps
        if self.by_word:
            # The same vocabulary and merges for pieces that are normal and split already.
            bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            self.pieces = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": bytes_only, "added_tokens": []}))
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def encoded(self, texts: list[str], tokenizer=None) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 5_000):
            out += [np.array(e.ids, self.type).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts[k : k + 5_000], add_special_tokens=False)]
        return out

    def looked_up(self, pieces: list[str], memory: dict[str, bytes]) -> list[bytes]:
        found = [memory.get(piece) for piece in pieces]
        missing = [k for k, b in enumerate(found) if b is None]
        told = self.encoded([pieces[k] for k in missing], self.pieces)
        for k, b in zip(missing, told, strict=True):
            found[k] = b
        room = max(0, CACHED_WORDS - len(memory))  # what comes first is the commonest
        memory.update((pieces[k], b) for k, b in zip(missing[:room], told, strict=False))
        return found

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and the offsets of the words."""
        split = pc.extract_regex(pc.utf8_lower(words), PLAIN)
        dotted = pc.match_substring(words, "\u0130")  # lower-cases to a letter and a combining dot
        odd = pc.or_(pc.is_null(split), dotted).to_numpy(zero_copy_only=False)
        heads, tails = (pc.fill_null(pc.struct_field(split, name), "").dictionary_encode() for name in ("head", "tail"))
        parts = [*self.looked_up(heads.dictionary.to_pylist(), self.letters), *self.looked_up(tails.dictionary.to_pylist(), self.marks), *self.encoded(words.filter(pa.array(odd)).to_pylist())]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.type.itemsize
        flat, starts = np.frombuffer(b"".join(parts), self.type), np.cumsum(sizes) - sizes
        n = len(heads.dictionary)
        of = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + n], 1).astype(np.int64)
        none = len(parts)  # an odd word is one piece, and an empty one
        of[odd] = np.stack([np.arange(none - odd.sum(), none), np.full(odd.sum(), none)], 1)
        sizes, starts = np.append(sizes, 0)[of], np.append(starts, 0)[of]
        return flat[common.ranges(starts.reshape(-1), sizes.reshape(-1))], np.concatenate([[0], np.cumsum(sizes.sum(1))])

    def batch(self, texts: pa.Array) -> pa.Array:
        """The ids of every text, as binary."""
        if not self.by_word:
            return pa.array(self.encoded([t or "" for t in texts.to_pylist()]), pa.binary())
        codes, distinct, offsets = common.coded_words(texts)
        flat, bounds = self.words(distinct)
        lengths = np.diff(bounds)[codes]
        ids = flat[common.ranges(bounds[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets] * self.type.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def _tokenise(path: str, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            bucket = np.searchsorted(bounds, ids.fill_null(-(2**63)).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), ids, encoder.batch(batch.column("text"))], ["bucket", "doc_id", "ids"])

    return run


def _counts(kind: np.dtype):
    """(id, n) of a task's texts, end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(END_ID + 1, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)]) + found
            total[END_ID] += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def _chunk(bucket: int, chunk: int, doc_ids: list, ids: list[bytes], kind: np.dtype, rank_of: np.ndarray) -> dict:
    end = np.array([END_ID], kind).tobytes()
    flat = np.frombuffer(end.join(ids) + end, kind)
    lengths = np.array([len(b) // kind.itemsize + 1 for b in ids], "<u4")
    control, data = encode_ranks(rank_of[flat])
    return {
        "bucket": bucket, "chunk": chunk, "n_tokens": len(flat), "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "null_ids": sum(d is None for d in doc_ids), "lengths": lengths.tobytes(), "control": control, "data": data,
    }


_ARROW_CHUNK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.int64()), ("lengths", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def _encode(kind: np.dtype, rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunk, doc_ids, ids, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_chunk(bucket, chunk, doc_ids, ids, kind, rank_of)], _ARROW_CHUNK)

        for batch in batches:
            for b, d, i in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if ids and (b != bucket or size >= CHUNK_TOKENS):
                    yield flush()
                    chunk, doc_ids, ids, size = chunk + 1 if b == bucket else 0, [], [], 0
                bucket = b
                doc_ids.append(d)
                ids.append(i)
                size += len(i) // kind.itemsize + 1
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, stage: common.Stage, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenise and write; the tables of chunks and of ranks (rank, id), read back from their files."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, min(MOST_BUCKETS, -(-size // BUCKET_CHARS)))
    cuts = [k / n for k in range(1, n)]
    bounds = (docs.agg(F.percentile_approx("doc_id", cuts, 10 * n)).first()[0] or []) if cuts else []
    kind = encoder_of(tokenizer).type
    tokenised = common.mapped(docs, _tokenise(tokenizer, np.array(sorted(set(bounds)), np.int64)), TOKENISED)
    held = stage.table("tokens", tokenised)
    counted = common.mapped(held, _counts(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1  # rows as many as the vocabulary
    ranks = stage.table("ranks", counted.select(order.alias("rank"), "id"))
    pairs = ranks.collect()
    rank_of = np.zeros(max((r["id"] for r in pairs), default=0) + 1, np.uint32)
    rank_of[[r["id"] for r in pairs]] = [r["rank"] for r in pairs]
    dealt = held.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    chunks = stage.table("chunks", common.mapped(dealt, _encode(kind, rank_of), CHUNK))
    stage.drop("tokens")
    return chunks, ranks


def _decode(ranked: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = ranked[decode_ranks(row["control"], row["data"], row["n_tokens"])]
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                raw, cuts = memoryview(flat.astype("<u4").tobytes()), np.concatenate([[0], ends]) * 4
                pieces = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                ids = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, mask=np.arange(len(ids)) < row["null_ids"]), pa.array(row["base"] + ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array([bytes(p) for p in pieces] if with_ids else [None] * len(pieces), pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read(chunks: DataFrame, ranks: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) from the files.

    Bases are summed over one small row a chunk, within buckets and then over at most ``MOST_BUCKETS``
    buckets; null ids come first in a bucket, hence in a chunk.
    """
    ranked = np.array([r["id"] for r in ranks.orderBy("rank").collect()], np.uint32)
    sizes = chunks.select("bucket", "chunk", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    buckets = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens")).select("bucket", before(W.orderBy("bucket")).alias("lead"))
    within = sizes.select("bucket", "chunk", before(W.partitionBy("bucket").orderBy("chunk")).alias("within"))
    bases = within.join(F.broadcast(buckets), "bucket").select("bucket", "chunk", (F.col("lead") + F.col("within")).alias("base"))
    if sizes.count() <= common.BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return common.mapped(chunks.join(bases, ["bucket", "chunk"]), _decode(ranked, with_ids), DECODED)
