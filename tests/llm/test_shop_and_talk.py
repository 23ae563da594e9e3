"""Operators 11 to 13 against plain versions, on odd inputs and on the small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docev.llm import common, queries, ranking, repair, simhash
from tests.test_explain import plan

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stage(spark):
    return common.Stage(spark, "test")


# --- op11 -----------------------------------------------------------------------------------


def plain_print(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance=4):
    """Smallest id reachable for each place of ``prints``; ids may be null."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values) <= distance).tolist():
            parent[root(k)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(prints))]


def test_simhash_of_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in common.documents(spark, ROOT).select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in docs]
    expected = {(i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, plain_components(prints, [i for i, _ in docs]), strict=True)}
    found = queries.op11_simhash(spark, ROOT).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(docs)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"Wort{k % 911}" for k in range(40_000))
    rows = [(1, "A b C d e"), (2, "a B c D e"), (3, None), (4, ""), (5, " \n\t"), (6, "one"), (7, "ONE"), (8, "one two three"), (9, long), (10, long.lower()), (None, "a b c d e"), (None, "nobody else says so"),
            (2, "a B c D e"), (11, "Ünï ÀÉ 日本 x y"), (12, "\x1c a\x85b c d e f")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, component_id string").repartition(3)
    found = sorted(map(repr, (tuple(r) for r in simhash.find(frame, stage(spark)).select("doc_id", "fingerprint", "component_id").collect())))
    prints = [plain_print(t) for _, t in rows]
    assert found == sorted(repr((i, f"{p:016x}", c)) for (i, _), p, c in zip(rows, prints, plain_components(prints, [i for i, _ in rows]), strict=True))
    assert simhash.find(frame.limit(0), stage(spark)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_fingerprints_do_not_depend_on_pieces(piece):
    text = " ".join(random.Random(3).choices(["Ab", "c", "déf", "\tgh\n", "ijklmnopq"], k=500))
    assert simhash.fingerprint(text.encode(), piece=piece) == plain_print(text)


def clustered(seed, n, weak):
    """Values about one centre that differ in some weak bits, and others anywhere."""
    draw = random.Random(seed)
    centre, bits = draw.getrandbits(64), draw.sample(range(64), weak)
    near = {centre ^ sum(1 << b for b in bits if draw.random() < 0.25) for _ in range(n)}
    return sorted(near | {draw.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1})


@pytest.mark.parametrize(("distance", "cell"), [(4, 1024), (4, 16), (2, 64), (1, 8)])
def test_links_of_close_fingerprints(spark, distance, cell):
    values = clustered(distance * 100 + cell, 700, 14)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "node long")
    found = {(r.node % (1 << 64), r.root % (1 << 64)) for r in simhash.links(nodes, stage(spark), distance, cell).collect()}
    joined = {v: v for v in values}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in found:
        joined[root(a)] = root(b)
    expected = plain_components(values, list(range(len(values))), distance)
    groups = {}
    for v, c in zip(values, expected, strict=True):
        groups.setdefault(c, set()).add(root(v))
    assert all(len(g) == 1 for g in groups.values()) and len({root(v) for v in values}) == len(groups)


def test_thresholds_are_the_cheapest():
    draw = random.Random(5)
    for parts in (2, 3, 4, 5):
        costs = [sorted(draw.random() * 10**k for k in range(6)) for _ in range(parts)]
        total, chosen = simhash.allotted(costs)
        every = [c for c in itertools.product(range(6), repeat=parts) if sum(c) == 5]
        assert total == pytest.approx(min(sum(costs[i][k] for i, k in enumerate(c)) for c in every)) and sum(t + 1 for t in chosen) == 5


def test_correlated_bits_share_a_part():
    correlation = np.zeros((64, 64))
    for a in range(0, 64, 16):  # blocks of bits that are strewn over the word
        block = [(a + k * 5) % 64 for k in range(16)]
        correlation[np.ix_(block, block)] += 0.9
    parts = simhash.grouped(np.eye(64) + np.kron(np.ones((16, 16)), np.eye(4)) * 0.8, 4)
    assert sorted(map(tuple, parts)) == [tuple(range(k, 64, 4)) for k in range(4)]
    assert sorted(b for p in simhash.grouped(correlation, 5) for b in p) == list(range(64))


def test_candidate_estimates_follow_the_nodes(spark):
    values = np.array(clustered(9, 3000, 12), np.uint64)
    bits = list(range(12))
    squares = (simhash.sketch(values, [bits]).reshape(simhash.ROWS, simhash.WIDTH).astype(float) ** 2).sum(1)
    true = float((np.unique(simhash.projected(values, bits), return_counts=True)[1].astype(float) ** 2).sum())
    assert np.median(squares) == pytest.approx(true, rel=0.25)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64).tolist()], "node long").repartition(3)
    seen = simhash._summed(nodes, simhash.together, 64 * 64 + 1)
    rows = simhash.bit_rows(values).astype(int)
    assert (seen[:-1].reshape(64, 64) == rows.T @ rows).all() and seen[-1] == len(values)


# --- op12 -----------------------------------------------------------------------------------

KEYS, PAIR, REST = ["g", "h"], [("a", "desc", "first"), ("b", "asc", "first")], [("c", "asc", "last"), ("d", "desc", "last")]


def plain_ranks(rows, k, place):
    up = lambda v, last: ((v is None) == last, 0 if v is None else v)
    down = lambda v, last: ((v is None) == last, 0 if v is None else -v)
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    out = []
    for group in groups.values():
        group.sort(key=lambda r: (down(r[2], False), up(r[3], False), up(r[4], True), down(r[5], True)))
        pairs = [r[2:4] for r in group]
        for k0, r in enumerate(group):
            at = k0 + 1 if place == "pos" else pairs.index(r[2:4]) + 1
            if at <= k:
                out.append((*r, k0 + 1, at, pairs.count(r[2:4])))
    return out


@pytest.mark.parametrize("place", ["pos", "rank"])
@pytest.mark.parametrize(("hot", "ranges", "k"), [(1000, 3, 2), (3, 7, 1), (10**6, 5, 4)])
def test_ranks_with_ties(spark, place, hot, ranges, k):
    draw = random.Random(hot + k)
    some = lambda n: draw.choice([None, *range(n)])
    rows = [(some(3), some(2), some(4), some(3), some(5), some(2)) for _ in range(900)] + [(1, 1, 3, 0, 0, 0)] * 400 + [(2, None, None, None, None, None)] * 50
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "g int, h int, a int, b int, c int, d int, rk_n int, pos string").repartition(4)
    frame = stage(spark).table("rows", frame)
    found = ranking.ranked(frame, KEYS, PAIR, REST, k, stage(spark), place, bins=64, hot=hot, ranges=ranges)
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(map(repr, plain_ranks(rows, k, place)))


def test_ranks_of_nothing(spark):
    frame = spark.createDataFrame([], "g int, h int, a int, b int, c int, d int")
    assert ranking.ranked(frame, KEYS, PAIR, REST, 2, stage(spark)).count() == 0


def test_ranking_runs_no_python_and_no_single_task(spark):
    text = plan(queries.op12_grouped_ranking(spark, ROOT))
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop|SinglePartition", text)


# --- op13 -----------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for i, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        draw = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(i, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def plain_faults(rows):
    """Of one conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        stripped = text.strip(repair.SPACES)
        out.append(1 if not stripped else 2 if (role, text) in seen else 3 if stripped[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def plain_edits(roles, faults):
    """The cheapest edits by a search over (row, state), least first: cost, initials and the resulting roles."""
    told, n = {"0": "u", "s": "u", "u": "a", "a": "u"}, len(roles)
    allowed = {"0": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(k, state, inserts):
        options = []
        if k == n and state in "0a":
            options.append((0, "", ()))
        if inserts < 2:
            c, a, r = best(k, told[state], inserts + 1)
            options.append((c + 3, "I" + a, (told[state] + "+", *r)))
        if k < n:
            c, a, r = best(k + 1, state, 0)
            options.append((c + 4, "D" + a, ("", *r)))
            if faults[k] in (0, 3):
                cut = 3 if faults[k] else 0
                c, a, r = best(k + 1, told[state], 0)
                options.append((c + 3 + cut, "R" + a, (told[state] + "=", *r)))
                if roles[k][:1] in tuple(allowed[state]):
                    c, a, r = best(k + 1, roles[k][0], 0)
                    options.append((c + cut, "K" + a, ("=", *r)))
        return min(options) if options else (10**9, "", ())

    return best(0, "0", 0)


def plain_audit(rows):
    """All of a conversation's columns from its rows after damage, in order."""
    faults, roles = plain_faults(rows), [r[2] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [(a[:1] + b[:1]) for a, b in itertools.pairwise(roles)]
    cost, audit, result = plain_edits(tuple(roles), tuple(faults))
    lines, k = [], 0
    for edit, told in zip(audit, result, strict=True):
        name = {"u": "user", "a": "assistant"}.get(told[:1])
        if edit == "I":
            lines.append(f"{name}:")
        else:
            if edit != "D":
                lines.append(f"{name or roles[k]}:{rows[k][3]}")
            k += 1
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(ids, rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{'n' if r[0] is None else f'c{r[0]}'}:{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    return {(i, *plain_audit(sorted((r for r in rows if r[0] == i), key=key))) for i in ids}


COLUMNS = ["conv_id", *repair.AUDIT, "audit", "repaired_sha256"]


def test_repair_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, ROOT).select(COLUMNS).collect()
    assert {tuple(r) for r in found} == by_conversation({r[0] for r in rows}, plain_damage(rows)) and len(found) == len({r[0] for r in rows})


@pytest.fixture(scope="module")
def talk():
    draw = random.Random(11)
    texts = ["Yes.", "No!", "why", "", " \n", "So?  ", "so be it", "日本。", ". ", None]
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *range(12)]), draw.choice(["user", "assistant", "system", "tool", "", None, "u"]), draw.choice(texts)) for _ in range(700)]
    return rows + [(100, k, "user" if k % 3 else "assistant", f"t{k % 40}{'.' if k % 7 else ''}") for k in range(300)]


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_repair_in_blocks_of_any_size(spark, talk, bits, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    frame = spark.createDataFrame([(*r, 1, "x") for r in talk], "conv_id long, turn long, role string, text string, block int, edit string").repartition(3)
    made = stage(spark)
    found = repair.audits(repair.repair(repair.damaged(frame), made), frame, made).select(COLUMNS).collect()
    assert {tuple(r) for r in found} == by_conversation({r[0] for r in talk}, plain_damage(talk))


def test_repair_of_nothing_and_of_dropped_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = stage(spark)
    assert repair.audits(repair.repair(repair.damaged(frame), made), frame, made).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], frame.schema)
    made = stage(spark)
    row = repair.audits(repair.repair(repair.damaged(frame), made), frame, made).select(COLUMNS).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_conversation_ids_of_any_type(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "assistant", "Ho."), (None, None, "system", "x")]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    made = stage(spark)
    told = repair.repair(frame, made)
    found = {r.conv_id: (r.audit, r.cost) for r in repair.audits(told, frame, made).collect()}
    assert found == {"a": ("KK", 0), "b": ("IK", 3), None: ("D", 4)}
    assert told.where(F.col("edit") == "I").select("role", "text").first() == ("user", "")
