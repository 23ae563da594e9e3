"""Operator 11: SimHash near-duplicates by the generalised pigeonhole principle.

A text's 64-bit fingerprint has a bit set where over half of its shingles' XXH64 have it. Fingerprints
link at ``DISTANCE`` or fewer differing bits. Texts of one fingerprint are one node from the start.

Search: the 64 bits are dealt to m parts, correlated bits together, and part i gets a threshold t_i >= -1
such that the sum of t_i + 1 is ``DISTANCE + 1``. If two fingerprints were more than t_i bits apart in every
part they would differ in at least that many bits, so each linked pair is within t_i in some part; a part of
-1 isn't searched. What groups the bits is their correlation over all nodes. What a threshold costs is
estimated from all nodes: pairs that are equal in a part by a sketch of the second moment of its values, pairs
within t by the ratio that the bits' own spreads give. Dynamic programming over the parts picks the cheapest
thresholds, for each number of parts, and the cheapest number of parts.

Probing: every node stands in the bucket of its own value, and visits the greater values within t_i bits.
Verification is exact, over whole fingerprints, in numpy: small buckets by the pair, in groups of many buckets;
a bucket of more than ``CELL`` entries is cut into cells by hash, which travel packed, two cells a row. What is
returned of a bucket is each node's smallest linked one, so that no pair of a large bucket is a row.

Defined results: A to Z are lower-cased and nothing else; a text of one to three words has one shingle, all its
words; a text without words (null, empty) has the fingerprint zero and links like any other; a component's id
is its smallest doc_id, null if none has one; rows without an id take part; repeated rows are copies; texts of
any length are read in pieces of ``PIECE`` bytes; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

SHINGLE, DISTANCE, SEED = 4, 4, 42
PIECE = 1 << 20
#: Numbers of parts that are weighed; with more parts than DISTANCE + 1 some would never be searched.
PARTS = (2, 3, 4, 5)
#: Sketch of a part's second moment: so many rows of so many counters.
ROWS, WIDTH = 5, 256
#: Entries of a bucket that one block holds; entries that one Python call holds, on average.
CELL, BUCKET = 1024, 50_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def pieces(raw: bytes, size: int, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists, each list led by the last ``size - 1`` words of the one before."""
    at, held = 0, []
    while at < len(raw):
        end = at + piece
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":  # whole words
            end += 1
        words = held + raw[at:end].split()
        at = end
        if len(words) >= size or at >= len(raw):
            yield words
            held = words[len(words) - size + 1 :] if len(words) >= size else words
        else:
            held = words


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words."""
    digest, whole = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - size + 1
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def fingerprint(raw: bytes, size: int = SHINGLE, piece: int = PIECE) -> int:
    total, count, last = np.zeros(64, np.int64), 0, []
    for words in pieces(raw.translate(_LOWER), size, piece):
        last = words
        if len(words) < size:
            continue
        hashes = shingle_hashes(words, size)
        for k in range(0, len(hashes), 1 << 16):
            part = hashes[k : k + (1 << 16)]
            total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        count += len(hashes)
    if not count and last:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big") if count else 0


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = np.array([fingerprint(t.as_py() or b"", size) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "node"])

    return run


def _nodes_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)


def bit_rows(nodes: np.ndarray) -> np.ndarray:
    """A row of 64 bits a node; column j is the bit of value 1 << j."""
    return np.unpackbits(nodes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def projected(nodes: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part in place, all others 0."""
    return nodes & np.uint64(sum(1 << b for b in bits))


# --- what all nodes say about the bits -------------------------------------------------------


def _summed(nodes: DataFrame, measure, length: int) -> np.ndarray:
    """The sum over all nodes of a vector of fixed length: by partition, then by sixteen groups, then here."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            total += measure(_nodes_of(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = nodes.select("node").mapInArrow(local, "sums binary").repartition(16).mapInArrow(merged, "sums binary").collect()
    return np.sum([np.frombuffer(r.sums, np.int64) for r in rows], axis=0) if rows else np.zeros(length, np.int64)


def together(nodes: np.ndarray) -> np.ndarray:
    """How often every two bits are set together; the diagonal has how often each is set; then the count."""
    total = np.zeros((64, 64), np.int64)
    for k in range(0, len(nodes), 1 << 14):
        rows = bit_rows(nodes[k : k + (1 << 14)]).astype(np.float32)
        total += (rows.T @ rows).astype(np.int64)
    return np.append(total.ravel(), len(nodes))


def grouped(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in parts of like size: each part begins with the strongest pair left and takes the bit that is
    most correlated with what it has."""
    left, out = list(range(64)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        among = correlation[np.ix_(left, left)].copy()
        np.fill_diagonal(among, -1)
        i, j = np.unravel_index(np.argmax(among), among.shape)
        part = [left[i], left[j]]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(rest[int(np.argmax(correlation[np.ix_(rest, part)].sum(1)))])
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def sketch(nodes: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """Signed counters of every part's values; the mean square of a row of them estimates how many ordered
    pairs of nodes (each with itself too) are equal in the part."""
    out = np.zeros((len(parts), ROWS, WIDTH), np.int64)
    for p, bits in enumerate(parts):
        value = projected(nodes, bits)
        for r in range(ROWS):
            h = common.mix64(value + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1))
            out[p, r] = np.bincount((h % np.uint64(WIDTH)).astype(np.int64), weights=np.where(h >> np.uint64(63), 1, -1), minlength=WIDTH).astype(np.int64)
    return out.ravel()


def ball(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(t + 1))


def cost(nodes: int, moment: float, differ: np.ndarray, t: int) -> float:
    """Entries and candidate pairs of one part at threshold ``t``. ``moment`` estimates the pairs that are
    equal in it; ``differ`` has the chance of each bit to differ between two nodes."""
    if t < 0:
        return 0.0
    chance = np.zeros(t + 1)
    chance[0] = 1.0
    for d in np.clip(differ, 0, 0.999):  # how many bits differ, if they differ one by one
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    equal = max(0.0, (moment - nodes) / 2)
    least = nodes * nodes / 2 * chance[0]  # what independent bits would give
    pairs = max(equal, least) * chance.sum() / max(chance[0], 1e-300)
    return nodes * (1 + (ball(len(differ), t) - 1) / 2) + min(pairs, nodes * nodes / 2)


def allotted(costs: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """The cheapest thresholds, -1 or more, whose sum of t + 1 is distance + 1. ``costs[i][t + 1]`` is the cost of
    threshold t in part i. Dynamic programming over parts and what is left to allot."""
    best = {0: (0.0, [])}
    for row in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for spent, (held, chosen) in best.items():
            for k, c in enumerate(row[: distance + 2 - spent]):
                if spent + k not in now or held + c < now[spent + k][0]:
                    now[spent + k] = (held + c, [*chosen, k - 1])
        best = now
    return best[distance + 1]


def scheme(nodes: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The parts that are searched, each with its bits and its threshold."""
    if distance < 1:
        return [(list(range(64)), 0)]
    seen = _summed(nodes, together, 64 * 64 + 1)
    n = max(int(seen[-1]), 1)
    share = seen[:-1].reshape(64, 64) / n
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    plans = [grouped(correlation, m) for m in PARTS]
    every = [part for plan in plans for part in plan]
    squares = (_summed(nodes, lambda x: sketch(x, every), len(every) * ROWS * WIDTH).reshape(len(every), ROWS, WIDTH).astype(np.float64) ** 2).sum(2)
    moments = iter(np.median(squares, axis=1).tolist())
    found = []
    for plan in plans:
        rows = [[cost(n, m, 2 * p[bits] * (1 - p[bits]), t) for t in range(-1, distance + 1)] for bits in plan for m in [next(moments)]]
        total, thresholds = allotted(rows, distance)
        found.append((total, [(bits, t) for bits, t in zip(plan, thresholds, strict=True) if t >= 0]))
    return min(found, key=lambda f: f[0])[1]


# --- probing and verification ----------------------------------------------------------------


@lru_cache(64)
def flips(bits: tuple[int, ...], t: int) -> np.ndarray:
    """All masks of one to ``t`` of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(bits, k)], np.uint64)


def _probe(parts: list[tuple[list[int], int]]):
    """Each node in its own bucket (home), and in the buckets of greater values that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = _nodes_of(batch)
            for part, (bits, t) in enumerate(parts):
                masks = flips(tuple(bits), t)
                step = max(1, 200_000 // (1 + len(masks)))
                for k in range(0, len(nodes), step):
                    mine = nodes[k : k + step]
                    value = projected(mine, bits)
                    around = value[:, None] ^ masks[None, :]
                    who, which = np.nonzero(around > value[:, None])
                    keys = np.concatenate([value, around[who, which]])
                    members, home = np.concatenate([mine, mine[who]]), np.concatenate([np.ones(len(mine), bool), np.zeros(len(who), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int8)), pa.array(keys.view(np.int64)), pa.array(members.view(np.int64)), pa.array(home)], ["part", "value", "node", "home"])

    return run


def smallest_linked(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of n members the smallest index that it is linked with, through any number of links."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, one, root[other])
        np.minimum.at(least, other, root[one])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _stars(nodes: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between indices of ``nodes`` as pairs of a node and its smallest linked one."""
    named, at = np.unique(nodes, return_inverse=True)
    root = smallest_linked(len(named), at[one], at[other])
    kept = np.flatnonzero(root != np.arange(len(named)))
    return named[kept], named[root[kept]]


def _pairs(distance: int, most: int = 1 << 21):
    """Links of a group of whole buckets. Each entry meets the bucket's later ones in sorted order, home first."""

    def run(table: pa.Table) -> pa.Table:
        part, value = table.column("part").to_numpy(), table.column("value").to_numpy()
        nodes, home = table.column("node").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False)
        order = np.lexsort((~home, value, part))
        part, value, nodes, home = part[order], value[order], nodes[order], home[order]
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])]))
        sizes = np.diff(np.append(first, len(nodes)))
        later = np.where(home, np.repeat(first + sizes, sizes) - np.arange(len(nodes)) - 1, 0)
        out = []
        cuts = np.searchsorted(np.cumsum(later), np.arange(0, int(later.sum()) + most, most), side="left")
        for a, b in zip(cuts[:-1].tolist(), np.append(cuts[1:-1], len(later)).tolist() if len(cuts) > 1 else [], strict=True):
            one = np.repeat(np.arange(a, b), later[a:b])
            other = common.ranges(np.arange(a, b) + 1, later[a:b])
            near = np.bitwise_count(nodes[one] ^ nodes[other]) <= distance
            out.append((one[near], other[near]))
        one, other = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        node, root = _stars(nodes, one, other)
        return pa.table([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], names=["node", "root"])

    return run


def _blocks(distance: int):
    """Links of two packed cells of a bucket, or of one with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_nodes, a_home, b_nodes, b_home in zip(*(batch.column(c).to_pylist() for c in ("a_nodes", "a_home", "b_nodes", "b_home")), strict=True):
                a, b = np.array(a_nodes, np.int64).view(np.uint64), np.array(b_nodes, np.int64).view(np.uint64)
                met = np.array(a_home, bool)[:, None] | np.array(b_home, bool)[None, :]
                one, other = np.nonzero(met & (np.bitwise_count(a[:, None] ^ b[None, :]) <= distance))
                node, root = _stars(np.concatenate([a, b]), one, other + len(a))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["node", "root"])

    return run


def links(nodes: DataFrame, stage: common.Stage, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Pairs (node, root) that join all nodes which are linked: a star a bucket and component."""
    parts = scheme(nodes, distance)
    entries = stage.table("entries", common.mapped(nodes.select("node"), _probe(parts), "part byte, value long, node long, home boolean"))
    sizes = entries.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    met = stage.table("met", sizes.where("homes > 0 and n > 1").select("part", "value", "n"))  # plain, so that the join can split
    joined = stage.table("joined", entries.join(met.hint("merge"), ["part", "value"]))
    stage.drop("entries", "met")
    small, total = joined.where(F.col("n") <= cell), joined.where(F.col("n") <= cell).count()
    bucket = F.pmod(F.xxhash64("part", "value"), F.lit(max(1, -(-total // BUCKET))))
    found = small.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(common.trimmed(_pairs(distance)), "node long, root long")

    cells = F.ceil(F.col("n") / cell).cast("int")
    large = joined.where(F.col("n") > cell).withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    packed = large.groupBy("part", "value", "cells", "cell").agg(F.collect_list("node").alias("nodes"), F.collect_list("home").alias("home"))
    packed = stage.table("packed", packed)
    meets = lambda me, other: F.explode(F.sequence(me, other))
    a = packed.select("part", "value", F.col("cell").alias("a"), F.col("nodes").alias("a_nodes"), F.col("home").alias("a_home"), meets(F.col("cell"), F.col("cells") - 1).alias("b"))
    b = packed.select("part", "value", F.col("cell").alias("b"), F.col("nodes").alias("b_nodes"), F.col("home").alias("b_home"))
    blocks = a.join(b.hint("merge"), ["part", "value", "b"]).select("a_nodes", "a_home", "b_nodes", "b_home")
    blocks = blocks.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wide = common.mapped(blocks, _blocks(distance), "node long, root long")
    out = stage.table("links", found.unionByName(wide))
    stage.drop("joined", "packed")
    return out


def find(docs: DataFrame, stage: common.Stage, size: int = SHINGLE, distance: int = DISTANCE, cell: int = CELL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with common.settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": common.BATCH_BYTES}):
        prints = stage.table("prints", common.mapped(rows, _fingerprints(size), "doc_id long, node long"))
    nodes = stage.table("nodes", prints.groupBy("node").agg(F.min("doc_id").alias("rid")))
    roots = graph.components(links(nodes, stage, distance, cell), "node", "root", stage, "roots")
    told = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage.table("named", told.groupBy("root").agg(F.min("rid").alias("component_id")))
    told = stage.table("told", told.join(named.hint("merge"), "root").select("node", "component_id"))
    joined = prints.join(told.hint("merge"), "node")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
