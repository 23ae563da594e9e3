"""Operator 6: n-gram Jaccard join through a MinHash LSH forest.

Each text's set of five-word shingles gets a path of ``DEPTH`` minima in each of ``TREES`` prefix tries.
The tries are one table of paths, sorted by Spark, whose rows keep the longest prefix that they share
with a neighbour. Texts that share a prefix of the present depth in some trie are candidates. Prefixes
begin at full depth and are shortened until the target recall: the links found are binned by similarity,
each stands for 1 / p(s) links, p(s) being the chance that a pair of similarity s shares a prefix of this
depth, and beside them stands one pair at the threshold that nothing has found yet. If the share found
is short of ``RECALL``, the search goes on at the longest prefix whose expected share meets it.

Candidates are joined in stars, so a bucket of any size makes as many rows as it has members, and the
stars' components are verified exactly: a component is cut into cells by size of set and by hash, and
every two cells that can hold a pair at the threshold meet once, in blocks of at most ``CELL`` texts
each, where all similarities are computed by matrix products. A component that shorter prefixes leave
as it was isn't verified again. No pair is a row; each text carries its number of links and its class.

Texts with the same word sequence are one node from the start and their copies are counted. Nodes are
told apart by 128-bit digests, shingles by 64-bit hashes.

Defined results: a text of one to four words has one shingle, all its words; a text without words
(null, empty) has none, links to nothing and is a class of its own; rows without an id take part like
all others; a class's id is its smallest doc_id, null if it has none; repeated rows count as copies; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9995
#: Bins of the similarities found, from the threshold to 1.
BINS = 20
CELL = 512
#: Texts that one Python call of the verification holds, on average.
BUCKET = 1000

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("paths", T.ArrayType(T.BinaryType()))])
ENTRY = T.StructType([T.StructField("path", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("match", T.IntegerType())])
SHINGLED = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
VERIFIED = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("bins", T.ArrayType(T.IntegerType()))])


def chance(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """That a pair of some similarity shares a prefix of ``depth`` minima in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(found: np.ndarray, depth: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> tuple[float, int]:
    """The recall at ``depth``, estimated from the links found in each bin of similarity, and the longest
    prefix of at most ``depth`` that is expected to meet the target."""
    similarity = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    similarity, links = np.append(similarity, threshold), np.append(found / chance(similarity, depth, trees), 1.0)
    share = [float((links * chance(similarity, k, trees)).sum() / links.sum()) for k in range(1, depth + 1)]
    return share[-1], next((k for k in range(depth, 0, -1) if share[k - 1] >= recall), 1)


def certain(threshold: float = THRESHOLD, depth: int = DEPTH, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix of at most ``depth`` by which every pair at the threshold is found with a chance of ``recall``,
    whatever else is linked. A search that begins there takes no depth from the links that it finds."""
    return shortened(np.zeros(BINS), depth, threshold, trees, recall)[1]


def shingle_batch(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of a batch (with repeats), the offsets of the texts, and the texts' digests."""
    codes, distinct, offsets = common.coded_words(texts)
    hashes = common.hash_words(distinct)[codes]
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    whole = common.rolled(hashes, size)
    at = common.ranges(offsets[:-1], counts)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    out = np.zeros(len(at), np.uint64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    fits = np.ones(len(at), bool)
    fits[ends[short]] = False
    out[fits] = whole[at[fits]]
    for k in short.tolist():
        out[ends[k]] = common.rolled(hashes[offsets[k] : offsets[k + 1]], int(lengths[k]))[0] + np.uint64(lengths[k])
    raw = memoryview(hashes.tobytes())
    digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out, ends, digests


def paths_of(shingles: np.ndarray, ends: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text that has shingles, a path in each trie: its number, then 16 bits of each minimum."""
    full = np.flatnonzero(np.diff(ends))
    starts = ends[:-1][full]
    out = np.empty((len(full), trees, 1 + 2 * depth), np.uint8)
    out[:, :, 0] = np.arange(trees)
    factors = common.mix64(np.arange(1, trees * depth + 1, dtype=np.uint64) * common._MIX) | np.uint64(1)
    for t in range(trees if len(full) else 0):
        for k in range(depth):
            least = np.minimum.reduceat(shingles * factors[t * depth + k], starts)
            out[:, t, 1 + 2 * k : 3 + 2 * k] = (least >> np.uint64(16)).astype(">u2").view(np.uint8).reshape(-1, 2)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _sign(size: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):  # what is multiplied stays in the cache
                part = batch.slice(k, 100)
                shingles, ends, digests = shingle_batch(part.column("text"), size)
                counts = np.array([len(common.sorted_unique(shingles[a:b])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)  # of the set, as bands need it
                paths = _binary(paths_of(shingles, ends, trees, depth).reshape(-1, 1 + 2 * depth))
                bounds = np.concatenate([[0], np.cumsum(np.where(counts > 0, trees, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(digests, pa.binary()), pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), paths)], ["doc_id", "key", "node", "n", "paths"])

    return run


def matches(paths: np.ndarray, depth: int) -> np.ndarray:
    """How many minima each of the sorted paths shares with the one before, in the same trie."""
    same = paths[1:] == paths[:-1]
    levels = same[:, 1::2] & same[:, 2::2] & same[:, :1]
    return np.logical_and.accumulate(levels, 1).sum(1) if depth else np.zeros(len(levels), np.int64)


def _grow(depth: int, shortest: int):
    """Of a sorted partition the entries that share at least ``shortest`` minima with a neighbour. What
    lies beyond the partition's ends is unknown, so its first and last entries match in full."""
    width = 1 + 2 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last entry, whose successor isn't known yet, and its match with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(-1, width)
            nodes = batch.column("node").to_pylist()
            before = np.array([depth])
            if held is not None:
                paths, nodes, before = np.concatenate([held[0], paths]), [held[1], *nodes], np.array([held[2]])
            left = np.concatenate([before, matches(paths, depth)])
            match = np.maximum(left[:-1], left[1:])
            kept = np.flatnonzero(match >= shortest)
            yield pa.RecordBatch.from_arrays([_binary(paths[kept]), pa.array([nodes[k] for k in kept.tolist()], pa.binary()), pa.array(match[kept].astype(np.int32))], ["path", "node", "match"])
            held = paths[-1:].copy(), nodes[-1], int(left[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([_binary(held[0]), pa.array([held[1]], pa.binary()), pa.array([depth], pa.int32())], ["path", "node", "match"])

    return run


def _shingle(size: int):
    """The shingle sets of the nodes that are asked for; rows whose text is another node's go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                shingles, ends, digests = shingle_batch(part.column("text"), size)
                wanted = part.column("node").to_pylist()
                found = [(d, common.sorted_unique(shingles[a:b]).tobytes()) for d, w, a, b in zip(digests, wanted, ends[:-1].tolist(), ends[1:].tolist(), strict=True) if d == w]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], ["node", "shingles"])

    return run


def linked(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets are at the threshold or above, as a symmetric matrix without a diagonal, and the
    similarities."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = np.zeros((n, n), np.float64)
    if n <= 12:
        for i in range(n):
            for j in range(i):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                    both = np.sort(np.concatenate([sets[i], sets[j]]))
                    shared[i, j] = shared[j, i] = np.count_nonzero(both[1:] == both[:-1])
    else:
        value = np.concatenate(sets)
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(value)))
        column = np.cumsum(new) - 1
        kept = times[column] > 1
        column, owner = column[kept], owner[kept]
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                dense = np.zeros((n, width), np.float32)
                dense[owner[a:b], column[a:b] % width] = 1
                present = np.unique(owner[a:b])
                part = dense[present]
                shared[np.ix_(present, present)] += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    out = (shared >= threshold * union - 1e-9) & (shared > 0)
    np.fill_diagonal(out, False)
    return out, shared / np.maximum(union, 1)


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """All meetings of a bucket: in each, links between the two cells, or within the one."""
        meeting, side = table.column("meeting").to_pylist(), table.column("side").to_numpy()
        nodes, copies, packed = table.column("node").to_pylist(), table.column("copies").to_numpy(), table.column("shingles").to_pylist()
        met: dict[str, dict[bytes, int]] = {}
        for k, m in enumerate(meeting):
            met.setdefault(m, {}).setdefault(nodes[k], k)
        out_node, out_links, out_root, out_bins = [], [], [], []
        for members in met.values():
            at = np.array([members[node] for node in sorted(members)])
            if len(at) < 2:
                continue
            link, similarity = linked([np.frombuffer(packed[k], np.uint64) for k in at.tolist()], threshold)
            if len(np.unique(side[at])) > 1:  # pairs within a cell are counted where it meets itself
                link &= side[at][:, None] != side[at][None, :]
            links = link @ copies[at].astype(np.int64)
            one, other = np.nonzero(link)
            place = np.clip((similarity[one, other] - threshold) / (1 - threshold) * BINS, 0, BINS - 1).astype(np.int64) if threshold < 1 else np.zeros(len(one), np.int64)
            bins = np.bincount(one * BINS + place, minlength=len(at) * BINS).reshape(-1, BINS).tolist()
            root = np.arange(len(at))
            while True:  # the smallest of those linked, until nothing changes
                reach = np.where(link, root[None, :], len(at)).min(axis=1)
                least = np.minimum(root, reach)
                least = least[least]
                if (least == root).all():
                    break
                root = least
            for i in np.flatnonzero(links).tolist():
                out_node.append(nodes[at[i]])
                out_links.append(int(links[i]))
                out_root.append(nodes[at[root[i]]])
                out_bins.append(bins[i])
        return pa.table([pa.array(out_node, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary()), pa.array(out_bins, pa.list_(pa.int32()))], names=["node", "links", "root", "bins"])

    return run


def _components(forest: DataFrame, depth: int, stage: common.Stage) -> DataFrame:
    """``node`` and ``root`` of the texts that share a prefix of ``depth`` minima, directly or through others."""
    entries = forest.where(F.col("match") >= depth).select(F.substring("path", 1, 1 + 2 * depth).alias("prefix"), "node")
    hubs = entries.groupBy("prefix").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("prefix", "hub")
    hubs = stage.table(f"hubs{depth}", hubs)  # plain, so that the join can split
    found = graph.components(entries.join(hubs, "prefix").where("node != hub").select("node", "hub"), "node", "hub", stage, f"candidates{depth}")
    stage.drop(f"hubs{depth}")
    return found


def _verified(rows: DataFrame, nodes: DataFrame, candidates: DataFrame, name: str, stage: common.Stage, threshold: float, size: int, cell: int) -> DataFrame:
    """VERIFIED rows of all pairs within the candidates' components."""
    # Sets whose sizes differ by more than the threshold are never linked: only cells of one band of
    # sizes, or of neighbouring ones, meet.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(threshold)) + 1e-9).cast("int") if threshold < 1 else F.col("n")
    members = candidates.join(nodes.select("node", "rid", F.coalesce("first.key", "loose").alias("key"), "copies", "n"), "node").withColumn("band", band)
    bands = members.groupBy("root", "band").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("cells"))
    listed = stage.table(f"cells{name}", bands.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "cells"))).alias("cells")))
    placed = members.join(listed, "root").withColumn("own", F.col("cells")[F.col("band")])
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    label = lambda b1, c1, b2, c2: F.concat_ws(",", F.hex("root"), b1, c1, b2, c2)
    here, at, none = F.col("band"), F.col("cell"), F.array().cast("array<struct<meeting:string,side:int>>")
    count = lambda b: F.coalesce(F.try_element_at("cells", b), F.lit(0))
    others = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(none)
    meeting = lambda m, s: F.struct(m.alias("meeting"), s.cast("int").alias("side"))
    same = others(F.col("own"), lambda j: meeting(label(here, F.least(at, j), here, F.greatest(at, j)), (j < at) & (j != at)))
    above = others(count(here + 1), lambda j: meeting(label(here, at, here + 1, j), F.lit(0)))
    below = others(count(here - 1), lambda j: meeting(label(here - 1, j, here, at), F.lit(1)))
    placed = placed.withColumn("meetings", F.concat(same, above, below)).select("node", "rid", "key", "copies", "meetings")
    placed = stage.table(f"placed{name}", placed)
    stage.drop(f"cells{name}")
    total = placed.agg(F.sum(F.size("meetings"))).first()[0] or 0

    # The join of all texts is dealt by id at every size, however few the candidates.
    # Of rows without an id, each text goes once.
    wanted = rows.join(placed.select(F.col("rid").alias("doc_id"), "key", "node").hint("merge"), ["doc_id", "key"]).select("node", "text")
    unnamed = rows.where("doc_id is null and key is not null").groupBy("key").agg(F.first("text").alias("text"))
    wanted = wanted.unionByName(unnamed.join(placed.where("rid is null").select("key", "node").hint("merge"), "key").select("node", "text"))
    shingled = stage.table(f"shingled{name}", common.mapped(wanted, _shingle(size), SHINGLED))
    dealt = placed.join(shingled, "node").select("node", "copies", "shingles", F.explode("meetings").alias("m")).select("node", "copies", "shingles", "m.meeting", "m.side")
    buckets = max(1, -(-int(total) // BUCKET))
    verified = dealt.withColumn("bucket", F.pmod(F.xxhash64("meeting"), F.lit(buckets))).groupBy("bucket").applyInArrow(common.trimmed(_verify(threshold)), VERIFIED)
    verified = stage.table(f"verified{name}", verified)
    stage.drop(f"shingled{name}", f"placed{name}")
    return verified


def _classes(docs: DataFrame, stage: common.Stage, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
             recall: float = RECALL, cell: int = CELL, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per node: root, links, copies and rid, the first of its rows' ids."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), common.text_key(F.col(text)).alias("key"))
    signed = stage.table("signed", common.mapped(rows, _sign(size, trees, depth), SIGNED))
    first, loose = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))), F.min(F.when(F.col("doc_id").isNull(), F.col("key")))
    copies = signed.where("n > 0").groupBy("node").agg(first.alias("first"), loose.alias("loose"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"))
    nodes = stage.table("nodes", copies.withColumn("rid", F.col("first.doc_id")))

    # Without any link found, this depth meets the target: prefixes shorter than it are rarely needed.
    shortest = certain(threshold, depth, trees, recall)
    entries = nodes.select(F.explode("paths").alias("path"), "node").repartitionByRange("path", "node").sortWithinPartitions("path", "node")
    forest = stage.table("forest", common.mapped(entries, _grow(depth, shortest), ENTRY))
    candidates = _components(forest, depth, stage)
    verified = _verified(rows, nodes, candidates, str(depth), stage, threshold, size, cell)
    while True:
        found = np.zeros(BINS)
        for r in verified.select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():
            found[r["bin"]] = r["n"]
        _, shorter = shortened(found, depth, threshold, trees, recall)
        if shorter == depth:
            break
        depth, before = max(shorter, shortest), candidates
        candidates = _components(forest, depth, stage)
        # Components only grow: one with the same smallest node and as many nodes is the same.
        sizes = lambda frame: frame.groupBy("root").agg(F.count("*").alias("size"))
        same = candidates.join(sizes(candidates).join(sizes(before), ["root", "size"]).select("root"), "root", "left_semi").select("node")
        same = stage.table(f"same{depth}", same)
        changed = candidates.join(same, "node", "left_anti")
        more = _verified(rows, nodes, changed, str(depth), stage, threshold, size, cell)
        verified = more.unionByName(verified.join(same, "node", "left_semi"))
    stage.drop("forest")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = graph.components(verified.select("node", "root"), "node", "root", stage, "roots")
    told = nodes.select("node", "rid", "copies").join(links, "node", "left").join(roots, "node", "left")
    return signed, told.withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, stage: common.Stage, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
         recall: float = RECALL, cell: int = CELL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, class_id and n_links, the other rows at the threshold or above."""
    signed, told = _classes(docs, stage, threshold, size, trees, depth, recall, cell, doc_id, text)
    named = stage.table("named", told.groupBy("root").agg(F.min("rid").alias("class_id")))
    told = told.join(named, "root").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    with_words = signed.where("n > 0").select("doc_id", "node").join(told, "node").select("doc_id", "class_id", "n_links")
    without = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without)
