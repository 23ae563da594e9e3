"""Stored state, tracing, ranks, resampling and assignment against plain versions."""

from __future__ import annotations

import itertools
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docev import session
from docev.functions import fuzzy
from docev.operators import aggregate, assign, components, link, state, stats, tracing
from docev.plans import mechanisms, queries
from docev.streaming import delivery
from tests.test_explain import plan

# --- stored state ----------------------------------------------------------------------------

CHANGES = "id long, seq long, change long, op string, a string, b double"


def made_changes(seed, n=400):
    draw = random.Random(seed)
    rows = [(draw.choice([None, *range(30)]), draw.choice([None, *range(40)]), k, draw.choice(["I", "U", "U", "U", "D", None]), draw.choice([None, "x", "y", "z"]), draw.choice([None, -1.0, 0.0, 2.5])) for k in range(n)]
    return rows + draw.sample(rows, n // 10)


def plain_state(rows):
    """One pass in key and sequence order."""
    now, flagged = {}, {}
    for i, _, _, op, a, b in sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        flagged[i] = flagged.get(i, False) or (b is not None and b < 0)
        if op == "D":
            now.pop(i, None)
        else:
            held = now.setdefault(i, [None, None])
            now[i] = [a if a is not None else held[0], b if b is not None else held[1]]
    return {(i, *v, flagged[i]) for i, v in now.items()}


def new_table(spark):
    return state.StateTable(spark, f"{session.shared(spark)}/state-{uuid.uuid4().hex}", ["id"], ["seq", "change"], ["a", "b"], flags={"negative": "b < 0"})


def rows_of(frame):
    return {tuple(r) for r in frame.select("id", "a", "b", "negative").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_is_that_of_one_pass_in_order(spark, seed):
    rows = made_changes(seed)
    table, parts = new_table(spark), [rows[k::7] for k in (3, 6, 0, 5, 1, 4, 2)]
    for k, part in enumerate(parts):
        assert table.merge(spark.createDataFrame(part, CHANGES).repartition(2), "s", k)
    assert rows_of(table.current()) == plain_state(rows)
    version = table.store.read()[0]
    assert not table.merge(spark.createDataFrame(parts[0], CHANGES), "s", 4) and table.store.read()[0] == version
    assert table.merge(spark.createDataFrame(parts[2], CHANGES), "other", 0) and rows_of(table.current()) == plain_state(rows)
    assert len(table.store.read()[1]["layers"]) < 6
    first = table.current(1)
    assert rows_of(first) == plain_state(parts[0])  # an older version as it was
    assert table.vacuum() > 0 and rows_of(table.current()) == plain_state(rows)


def test_writers_that_meet(spark):
    rows = made_changes(3)
    one = new_table(spark)
    other = state.StateTable(spark, one.store.path, one.keys, one.order, one.values, flags=one.flags)
    stale = one.store.read()
    assert other.merge(spark.createDataFrame(rows[::2], CHANGES))
    assert not one.store.commit(stale[0] + 1, stale[1])  # the version is taken
    assert one.merge(spark.createDataFrame(rows[1::2], CHANGES)) and rows_of(other.current()) == plain_state(rows)
    assert new_table(spark).current() is None


def test_a_stream_of_changes_that_is_started_again(spark, tmp_path):
    rows = made_changes(4)
    table = new_table(spark)
    for k, part in enumerate((rows[:150], rows[150:300])):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    start = lambda mark: delivery.maintained(delivery.incoming(spark, f"{tmp_path}/in/*", spark.createDataFrame([], CHANGES).schema, files=1), table, "changes", f"{tmp_path}/{mark}").awaitTermination()
    start("one")
    assert rows_of(table.current()) == plain_state(rows[:300])
    spark.createDataFrame(rows[300:], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    start("one")
    assert rows_of(table.current()) == plain_state(rows)
    version = table.store.read()[0]
    start("lost")  # without its checkpoint all batches come again, under numbers that are there
    assert table.store.read()[0] == version and rows_of(table.current()) == plain_state(rows)


# --- tracing ---------------------------------------------------------------------------------


def plain_supported(claim, line, least):
    core = claim.strip()
    if len(core) < 4:
        return False
    for mark in ",，。；;、\n\t":
        core = core.replace(mark, " ")
    pieces = [p for p in core.split(" ") if len(p) >= 4] or [claim.strip()[:10]]
    return sum(p in line for p in pieces) >= max(least, int(len(pieces) * 0.6))


@pytest.mark.parametrize(("least", "block"), [(2, 100_000), (1, 7)])
def test_traces_are_those_of_every_pair(spark, least, block):
    draw = random.Random(block)
    words = ["生活污水", "经化粪池预处理", "排入管网", "boilerplate", "abcd", "bcde", "xy"]
    some = lambda n: " ".join(draw.choices(words, k=n))
    claims = [(k, some(draw.randint(1, 4)), draw.choice([None, "", "p1", "p12", "p2"])) for k in range(60)] + [(90, "x", "p1"), (91, None, "p1"), (92, "", None)]
    lines = [(draw.choice(["report", "approval", "theory", "historical_case"]), f"f{draw.randint(0, 9)}", draw.choice([None, "", "p1", "p2", "p123"]), draw.randint(1, 9), draw.choice([some(draw.randint(1, 5)), None])) for _ in range(80)]
    lines = list({(r[0], r[1], r[3]): r for r in lines}.values())
    rank = {"report": 1, "approval": 2, "historical_case": 3}
    expected = {}
    for i, claim, project in claims:
        mine = project or ""
        good = [
            r for r in lines if claim is not None and r[4] is not None and plain_supported(claim, r[4], least)
            and (r[0] not in ("report", "approval") or not mine or not r[2] or r[2] in mine or mine in r[2])
        ]
        best = min(good, key=lambda r: (r[0] in rank, rank.get(r[0], 0), r[1], r[3]), default=None)
        expected[i] = ("unsupported", None, None, None) if best is None else ("indirect" if best[0] == "historical_case" else "direct", best[0], best[1], best[3])
    held = spark.createDataFrame(claims, "qa_id long, claim string, project_id string")
    told = spark.createDataFrame(lines, "source_type string, source_file string, project_id string, line_start int, text string").repartition(3)
    found = tracing.traced(held, told, rank, least=least, block_rows=block).collect()
    assert {r.qa_id: (r.support, r.source_type, r.source_file, r.line_start) for r in found} == expected and len(found) == len(claims)


def test_lines_are_read_without_a_join(spark, small):
    text = plan(mechanisms.claim_trace(spark, small))
    assert "MapInArrow" in text and "NestedLoop" not in text and len(re.findall(r"^\(\d+\) SortMergeJoin", text, re.M)) == 2


# --- ranks -----------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_ranks_of_all_rows(spark, keys):
    draw = random.Random(8)
    rows = [(draw.choice([None, 1, 2]), draw.choice([None, *range(40)])) for _ in range(800)] + [(1, 7)] * 500
    found = aggregate.average_ranks(spark.createDataFrame(rows, "g int, v int").repartition(5), "v", "r", keys).collect()
    order = lambda v: -1 if v is None else v
    for r in found:
        others = [order(v) for g, v in rows if not keys or g == r.g]
        assert r.r == sum(v < order(r.v) for v in others) + (others.count(order(r.v)) + 1) / 2
    assert len(found) == len(rows)


@pytest.mark.parametrize("name", ["rank_ties", "wilcoxon", "line_ranks", "wilcoxon_groups"])
def test_no_rank_goes_through_one_task(spark, small, name):
    for part in plan(queries.QUERIES[name](spark, small)).split("\n("):
        assert not (part.partition(")")[2].strip().startswith("Window") and "windowspecdefinition([" in part), part[:200]
    assert "No Partition Defined" not in plan(queries.QUERIES[name](spark, small))


@pytest.mark.parametrize("seed", range(6))
def test_rank_sum_probabilities_are_those_of_all_signs(seed):
    draw = random.Random(seed)
    values = [draw.randint(1, 6) for _ in range(draw.randint(5, 12))]
    ranks = [sum(v < x for v in values) + (values.count(x) + 1) / 2 for x in values]
    w = min(sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in [[draw.random() < 0.4 for _ in ranks]])
    w = min(w, sum(ranks) - w)
    every = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(ranks))]
    doubled = sorted({int(2 * r) for r in ranks})
    times = [sum(int(2 * r) == d for r in ranks) for d in doubled]
    assert stats.rank_sum_p(w, doubled, times) == pytest.approx(min(1, 2 * sum(x <= w for x in every) / len(every)))


def test_wilcoxon_by_group(spark):
    rows = [("few", 1.0, 2.0)] * 4 + [("same", 1.0, 1.0)] * 6 + [("up", float(k), 0.0) for k in range(1, 9)] + [("big", float(k % 17), float(k * 5 % 19)) for k in range(400)] + [(None, 3.0, None), (None, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "g string, a double, b double")
    found = {r.g: r for r in stats.wilcoxon(frame, "a", "b", ["g"]).collect()}
    assert found["few"].p is None and found["up"].p == pytest.approx(2 / 2**8) and found["up"].w == 0 and found["same"].w is None and found["same"].n == 0
    d = np.array([k % 17 - k * 5 % 19 for k in range(400)])
    d = d[d != 0]
    ranks = np.array([(np.abs(d) < abs(x)).sum() + ((np.abs(d) == abs(x)).sum() + 1) / 2 for x in d])
    assert found["big"].w == min(ranks[d > 0].sum(), ranks[d < 0].sum()) and 0 < found["big"].p < 1
    exact = stats.rank_sum_p(found["big"].w, *map(list, np.unique((2 * ranks).astype(int), return_counts=True)))
    assert found["big"].p == pytest.approx(exact, rel=0.02)


# --- resampling ------------------------------------------------------------------------------


def test_intervals_are_those_of_a_plain_bootstrap(spark):
    draw = np.random.default_rng(3)
    one, two = draw.normal(100, 15, 6000).round(2), draw.exponential(20, 300).round(1)
    rows = [("one", float(v)) for v in one] + [("two", float(v)) for v in two] + [(None, 1.0), (None, None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    found = stats.bootstrap(frame.repartition(3), "v", ["g"], resamples=2000, cell=1000)
    told = {r.g: r for r in found.collect()}
    for name, values in (("one", one), ("two", two)):
        means = np.sort(draw.choice(values, (2000, len(values))).mean(1))
        r = told[name]
        assert r.n == len(values) and r["mean"] == pytest.approx(values.mean()) and r.se == pytest.approx(values.std(ddof=1) / len(values) ** 0.5)
        assert r.low == pytest.approx(means[50], rel=0.01) and r.high == pytest.approx(means[1950], rel=0.01)
    assert told[None].low is None and told[None].n == 1 and "none" not in told
    again = stats.bootstrap(frame.repartition(7), "v", ["g"], resamples=2000, cell=1000).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, told.values()))


def test_interval_without_keys(spark):
    row = stats.bootstrap(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", resamples=500, cell=100).collect()
    assert len(row) == 1 and row[0].low < 499.5 < row[0].high and row[0].n == 1000


# --- assignment ------------------------------------------------------------------------------


def greedy(edges):
    lefts, rights, out = set(), set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            out.add((a, b, s))
    return out


def in_turn(edges):
    used, out = set(), set()
    for left in sorted({e[0] for e in edges}):
        best = None
        for _, right, score in sorted(e for e in edges if e[0] == left):
            if right not in used and score > 0 and (best is None or score > best[1]):
                best = (right, score)
        if best and best[1] >= 80:
            out.add((left, best[0], "clean" if best[1] >= 90 else "needs_review"))
            used |= {best[0]} if best[1] >= 90 else set()
    return out


ORDER = lambda: [F.desc("s"), F.col("a"), F.col("b")]


@pytest.mark.parametrize("most", [200_000, 40, 7])
def test_assignments_in_chunks_of_any_size(spark, most):
    draw = random.Random(most)
    edges = sorted({(draw.randint(0, 40), draw.randint(0, 40)): 0 for _ in range(300)})
    edges = [(a, b, float(draw.choice([70, 80, 85, 90, 95]))) for a, b in edges] + [(100 + k, 100 + k + j, 90.0) for k in range(30) for j in (0, 1)]
    frame = spark.createDataFrame(edges, "a long, b long, s double").repartition(3)
    assert {tuple(r) for r in assign.one_to_one(frame, "a", "b", ORDER(), most).collect()} == greedy(edges)
    found = assign.one_sided(frame.withColumn("c", F.lit(40.0)), "a", "b", "a", "b", "s", "c", most=most)
    assert {(r.a, r.b, r.pair_status) for r in found.collect()} == in_turn(edges)


def test_a_long_chain_takes_few_jobs(spark):
    n = 5000
    edges = [(k, k, 2.0 * (n - k)) for k in range(n)] + [(k, k + 1, 2.0 * (n - k) - 1) for k in range(n)]
    frame = spark.createDataFrame(edges, "a long, b long, s double").repartition(4)
    group = f"chain-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    found = {tuple(r) for r in assign.one_to_one(frame, "a", "b", ORDER()).collect()}
    spark.sparkContext.setJobGroup("none", "none")
    assert found == greedy(edges) and len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 30


def test_vendors_of_clients(spark, small):
    edges = [(r.client_id, r.vendor_id, r.score) for r in mechanisms.client_vendors(spark, small).collect()]
    found = {(r.client_id, r.vendor_id, r.pair_status) for r in mechanisms.vendor_clients(spark, small).collect()}
    assert found == in_turn(edges) and found


@pytest.mark.parametrize("local", [1_000_000, 25])
def test_components(spark, local):
    draw = random.Random(local)
    edges = [(draw.randint(0, 200), draw.randint(0, 200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(3), local).collect()
    assert {(r.node, r.root) for r in found} == {(x, root(x)) for x in parent} and len(found) == len(parent)


# --- names and trees -------------------------------------------------------------------------


def test_similarities_of_many_pairs():
    draw = random.Random(6)
    some = lambda low, high: "".join(draw.choices("ab甲乙丙丁戊c\U0001f600", k=draw.randint(low, high)))
    pairs = [(a, a[: draw.randint(0, len(a))] + some(0, 6) if draw.random() < 0.5 else some(0, 30)) for a in (some(0, 14) for _ in range(5000))]
    pairs += [(some(40, 150), some(60, 200)) for _ in range(40)] + [("", ""), ("", "a"), ("a", "a"), ("a" * 64, "b" + "a" * 64), ("a" * 65, "a" * 63 + "b")]
    found = fuzzy.similar_many(*map(list, zip(*pairs, strict=True)))
    assert found == pytest.approx([fuzzy.similar(a, b) for a, b in pairs])


def test_paths_of_deep_trees_cycles_and_orphans(spark):
    rows = [(f"c{k}", f"n{k}", f"c{k - 1}" if k else None) for k in range(21)] + [("o", "orphan", "nowhere"), ("x", "X", "y"), ("y", "Y", "x"), ("z", "Z", "x"), ("self", "S", "self")]
    found = {r.code: r.path for r in link.region_paths(spark.createDataFrame(rows, "code string, name string, parent_code string")).collect()}
    assert found["c20"] == "/".join(f"n{k}" for k in range(21)) and found["o"] == "orphan" and found["c0"] == "n0"
    assert (found["x"], found["y"], found["z"], found["self"]) == ("Y/X", "X/Y", "Y/X/Z", "S") and len(found) == len(rows)
