"""Shared folder, table materialisation and Arrow word helpers used by the operators.

Every cut of lineage goes through a folder that all executors see: the one the cluster names in
``spark.checkpoint.dir``. Only where that is unset and the master is local is a temporary one made.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that separate words in every contract: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only after it has been counted and found to have no more rows.
BROADCAST_ROWS = 100_000
#: Arrow batches handed to Python hold at most so many bytes, whatever the length of a row.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A session on a cluster must name one; a local one gets its own."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            path = f"file://{tempfile.mkdtemp(prefix='docev-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


#: Deletes a finished execution's shuffle files at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Run with some session settings, and put back what was there."""
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't make one batch outgrow a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give free memory back to the system: a worker waits for its next task with little of its own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose worker releases its memory after each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return frame.mapInArrow(tidy, schema)


def trimmed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A group's function, and the same release after each group."""

    def tidy(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return tidy


class Stage:
    """A folder of tables in the shared folder, written once and read back by later steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docev-{name}-{uuid.uuid4().hex}"

    def table(self, name: str, frame: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        with settings(self.spark, {CLEANUP: "true"}):  # the shuffles behind a written table aren't read again
            frame.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_small(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join on one null-safe key: a broadcast while ``small`` has few rows, else a sort-merge join
    of plain exchanges, which AQE splits where a key has a third of ``big``."""
    right = small.withColumnRenamed(key, "__key")
    right = F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge")
    return big.join(right, big[key].eqNullSafe(right["__key"]), "left").drop("__key")


def without(frame: DataFrame, prefix: str) -> DataFrame:
    """The rows without extra columns whose names begin with an operator's own prefix."""
    return frame.drop(*[c for c in frame.columns if c.lower().startswith(prefix)])


def by_id(docs: DataFrame, ids: DataFrame, how: str, few: bool = False, doc_id: str = "doc_id") -> DataFrame:
    """Semi or anti join of the rows with a table of ids, null-safe. ``few``: the ids are counted, and
    broadcast while they are at most ``BROADCAST_ROWS`` longs."""
    right = ids.select(F.col("doc_id").alias("__id")).distinct()
    if few:
        right = right.checkpoint()
        right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right.hint("merge")
    else:
        right = right.hint("merge")
    return docs.join(right, docs[doc_id].eqNullSafe(right["__id"]), how)


def text_key(text: Column) -> Column:
    """A text's 128-bit digest; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in order, and the offsets at which each text's words begin (one more
    offset than texts). Nulls and empty texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = (pc.binary_length(texts).to_numpy() == 0).astype(np.int64)
    if empty.any():  # an empty text splits to one empty word
        words = words.filter(pc.greater(pc.binary_length(words), 0))
        offsets = offsets - np.concatenate([[0], np.cumsum(empty)])
    return words, offsets


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes of a batch, its distinct words, and the offsets of the texts."""
    words, offsets = flat_words(texts)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, offsets


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Keys of two independent hashes of a word (pandas takes 16 characters).
HASH_KEYS = ("0123456789123456", "6543219876543210")


def hash_words(distinct: pa.Array, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every process; keys 0 and 1 are independent."""
    import pandas as pd

    if not len(distinct):
        return np.zeros(0, np.uint64)
    return mix64(pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), hash_key=HASH_KEYS[key], categorize=False))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that start at each position; positions past the last full run are cut."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= _MIX
        out += hashes[k : k + size]
    return mix64(out)


def sorted_unique(keys: np.ndarray) -> np.ndarray:
    """np.unique by a plain sort, which is many times faster here for 64-bit keys."""
    if not len(keys):
        return keys
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated index ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
