"""Operator 9: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in numpy over Arrow batches, and written. A bounded
sample of labelled rows is binned by quantiles and fitted on the driver; the trees are flattened into
arrays (feature, threshold, children, value) and every row is scored by vectorised traversal.

Sample bound: at most ``SAMPLE`` labels, those with the smallest hash of their id, and of the rows that
they mark at most as many, those with the smallest hash of their statistics. Only the text's
statistics are inputs; labels, lang, source and ids are not.

Defined results: a null or empty text has zero statistics and is scored like any other; labels whose
quality is null are not learnt from, repeated labels each count; without any label, or with one class
only, every score is that class's smoothed share (0.5 without labels); rows that repeat are each
scored; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 40_000
TREES, LEAVES_DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.15, 64, 20, 1.0
CUT = 0.7

#: Byte classes whose shares of a text are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\v\f", "line": b"\n", "stop": b".,;:", "bang": b"!?",
    "symbol": b"#*$%&|<>=@^~_+/\\", "bracket": b"()[]{}\"'",
}
FEATURES = ("log_bytes", "log_words", "mean_word", "long_word", "distinct", "top_word", "repeat_pairs", "dup_lines", "words_a_line", "non_ascii", *CLASSES)
_TABLE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _TABLE[np.frombuffer(_bytes, np.uint8)] = _k + 1
_TABLE[128:] = len(CLASSES) + 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group the number of distinct values and the count of the commonest."""
    key = np.sort(group.astype(np.uint64) << np.uint64(32) | value.astype(np.uint64))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = (key[first] >> np.uint64(32)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(first, len(key))))
    return np.bincount(of, minlength=n).astype(np.float64), most


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text of a batch."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    codes, distinct, offsets = common.coded_words(texts)
    words = np.diff(offsets)
    doc = np.repeat(np.arange(n), words)
    sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)[codes]
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
    raw = b"".join(texts.cast(pa.large_binary()).to_pylist())
    kinds = _TABLE[np.frombuffer(raw, np.uint8)]
    length = np.maximum(np.diff(bounds), 1)
    shares = [_sums(kinds == k, bounds) / length for k in range(1, len(CLASSES) + 2)]
    count = np.maximum(words, 1)
    kinds_of, most = _distinct(doc, codes, n)
    inside = doc[1:] == doc[:-1]
    pairs = (codes[:-1].astype(np.uint64) * common._MIX ^ common.mix64(codes[1:].astype(np.uint64)))[inside] >> np.uint64(32)
    pair_kinds, _ = _distinct(doc[1:][inside], pairs, n)
    lines = pc.split_pattern(texts, "\n")
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy()
    line_counts = np.diff(lines.offsets.to_numpy())
    line_kinds, _ = _distinct(np.repeat(np.arange(n), line_counts), line_codes, n)
    columns = [
        np.log1p(np.diff(bounds)), np.log1p(words), _sums(sizes, offsets) / count, _sums(sizes > 12, offsets) / count, kinds_of / count, most / count,
        1 - pair_kinds / np.maximum(words - 1, 1), 1 - line_kinds / np.maximum(line_counts, 1), np.log1p(words / np.maximum(line_counts, 1)), shares[-1], *shares[:-1],
    ]
    return np.stack(columns, 1).astype(np.float32)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            found = statistics(part.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "statistics"])


def measure(docs: DataFrame, stage: common.Stage, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    common.small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("statistics", T.ArrayType(T.FloatType()))])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage.table("statistics", common.mapped(rows, _measured, schema))


class Trees:
    """A fitted ensemble as flat arrays: node k of a tree goes to 2k+1 if the feature is at most the
    threshold, else to 2k+2; all trees have the same depth, early leaves are passed on."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1)) if self.feature.size else 0
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            total += self.value[t, at - self.feature.shape[1]]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = LEAVES_DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST, ridge: float = RIDGE) -> Trees:
    """Second-order boosting of the logistic loss over histograms, level by level."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    n, width = x.shape
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + flat).reshape(-1)
            hist = lambda w: np.bincount(slot, np.repeat(w, width), count * width * bins).reshape(count, width, bins).cumsum(2)  # noqa: E731, B023
            gl, hl, cl = hist(g), hist(h), hist(np.ones(n))
            gt, ht, ct = gl[..., -1:], hl[..., -1:], cl[..., -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = 0
            for k in range(count):
                f, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Trees:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    marked = measured.join(chosen, "doc_id").select("statistics", "y")  # an id that repeats marks all its rows
    rows = marked.orderBy(F.xxhash64("statistics", "y")).limit(sample).toPandas()
    x = np.array(rows["statistics"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    order = np.lexsort([*x.T, rows["y"].to_numpy()])  # the order of rows would change sums' last bits
    return fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score(measured: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every measured row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x))], ["doc_id", "score"])

    return common.mapped(measured, run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
