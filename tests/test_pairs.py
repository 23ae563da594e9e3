"""Queries on pairs of blocks: by classes, evenly dealt, and without their pairs, against plain versions and SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from docev.operators import assign, link
from docev.plans import queries

N = 30_000


def tables(spark, folder, customers, suppliers):
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """One nation whose 900 million pairs have one score."""
    rows = [(1009 * k, 1, 1.0) for k in range(N)]
    return tables(spark, tmp_path_factory.mktemp("alike"), rows, rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Keys below 0, none, large and of two nations; nations without suppliers."""
    customers = [(k * 37 - 400, k % 4, -1.0 if k % 3 else 5.0) for k in range(120)] + [(None, 0, 1.0), (9, 1, 1.0), (9, 2, None), (9, 1, 1.0), ((1 << 46) + 7, 1, 1.0), (11, None, 1.0), (2018 + 5, 6, 1.0), (5, 6, 2.0)]
    suppliers = [(k * 53 - 300, k % 3, -2.0 if k % 4 else 1.0) for k in range(60)] + [(21, 0, 1.0), (21, 1, 1.0), (1009 + 8, 6, 1.0), (8, 6, 1.0), (30, 7, 1.0)]
    return tables(spark, tmp_path_factory.mktemp("odd"), customers, suppliers)


def by_sql(folder, name, columns):
    base = duckdb.connect()
    for t in ("customer", "supplier"):
        base.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(repr, base.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()))


def same(spark, folder, name):
    frame = queries.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == by_sql(folder, name, columns)


def test_best_suppliers_of_one_class(spark, alike, odd):
    found = queries.best_per_left(spark, alike).agg(F.count("*"), F.max("s_suppkey"), F.max("best_score")).first()
    assert tuple(found) == (N, 0, 0)
    same(spark, odd, "best_per_left")


def test_best_by_class_is_the_best_of_all_pairs(spark):
    score = lambda a, b: (a * 5 + b * 3) % 7
    left = spark.createDataFrame([(k, k % 3, k % 7) for k in range(60)], "c long, n long, l long")
    right = spark.createDataFrame([(k, k % 2, k % 7) for k in range(40)], "s long, n long, r long")
    found = {(x.c, x.s, x.best_score) for x in link.best_by_class(left, right, "n", "l", "r", score(F.col("l"), F.col("r")), "s").collect()}
    of = lambda c: [(-score(c % 7, s % 7), s) for s in range(40) if s % 2 == c % 3]
    assert found == {(c, min(of(c))[1], -min(of(c))[0]) for c in range(60) if of(c)}


def test_mutual_best_of_one_class(spark, alike, odd):
    assert [tuple(r) for r in queries.mutual_best(spark, alike).collect()] == [(0, 0, 0)]
    pairs = {(r.score, r.c_custkey, r.s_suppkey) for r in queries._pairs(spark, odd).collect() if r.c_custkey is not None}
    best = lambda at: {p[at]: min((q for q in pairs if q[at] == p[at]), key=lambda q: (-q[0], q[1], q[2])) for p in pairs}
    assert {(r.score, r.c_custkey, r.s_suppkey) for r in queries.mutual_best(spark, odd).collect()} == set(best(1).values()) & set(best(2).values())


def test_all_pairs_are_dealt_evenly(spark, odd, tmp_path):
    """A nation's 12 million pairs, of one file each, in tasks of about 5 million."""
    folder = tables(spark, tmp_path, [(k, 1, float(k % 3 - 1)) for k in range(4_000)], [(k, 1, float(k % 5 - 1)) for k in range(3_000)])
    each = queries.pair_score(spark, folder).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in each) == 12_000_000 and max(r["count"] for r in each) < 6_000_000
    rows = [(k * 37 - 400, k % 4, -1.0 if k % 3 else None) for k in range(120)]
    same(spark, tables(spark, tmp_path / "signs", rows, rows), "pair_score")


def test_all_pairs_stand_in_runs_and_take_little_disk(spark, tmp_path):
    """Six million pairs take a fraction of a byte each as Parquet; suppliers in one long row for each customer take more."""
    folder = tables(spark, tmp_path / "in", [(k, 1, float(k % 3 - 1)) for k in range(300)], [(k, 1, float(k % 5 - 1)) for k in range(20_000)])
    queries.pair_score(spark, folder).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 6_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * 6_000_000


def test_scored_by_class_makes_each_pair_once(spark):
    """Wide classes in pieces and lists, rows that are equal or have no value, blocks of one side only."""
    left = spark.createDataFrame([(None if k % 7 == 0 else k // 2, 1 if k < 700 else k % 4, k % 2) for k in range(900)], "c long, n int, l int")
    right = spark.createDataFrame([(None if k % 5 == 0 else k // 3, 1 if k < 500 else k % 3 + 1, 0 if k < 400 else k % 3) for k in range(600)], "s long, n int, r int")
    scores = spark.createDataFrame([(a, b, a * 3 + b) for a in range(2) for b in range(3)], "l int, r int, score int")
    found = link.scored_by_class(left, right, "n", "l", "r", scores, 10_000)
    counted = lambda frame: {tuple(x) for x in frame.groupBy("n", "l", "r", "c", "s", "score").count().collect()}
    assert counted(found) == counted(left.join(right, "n").join(scores, ["l", "r"]))
    assert max(x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()) < 40_000
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.where("n = 0"), right)):
        assert link.scored_by_class(a, b, "n", "l", "r", scores).isEmpty()


def greedy(pairs):
    left, right, out = set(), set(), set()
    for score, c, s in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if c not in left and s not in right:
            left.add(c)
            right.add(s)
            out.add((c, s, score))
    return out


def test_greedy_pairs_of_one_class(spark, alike, odd, tmp_path):
    found = queries.greedy_pairs(spark, alike).agg(F.count("*"), F.sum((F.col("c_custkey") == F.col("s_suppkey")).cast("int"))).first()
    assert tuple(found) == (N, N)
    rows = [r for r in queries._pairs(spark, odd).collect() if r.c_custkey is not None]
    named = spark.read.parquet(f"{odd}/customer.parquet").where("c_custkey is not null").collect()
    folder = tables(spark, tmp_path, named, spark.read.parquet(f"{odd}/supplier.parquet").collect())
    assert {tuple(r) for r in queries.greedy_pairs(spark, folder).collect()} == greedy({(r.score, r.c_custkey, r.s_suppkey) for r in rows})


def test_a_class_of_equal_scores_is_refused(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "k long, n long, t long")
    with pytest.raises(Exception, match="equal scores"):
        assign.one_to_one_by_class(rows, rows.select(F.col("k").alias("o"), "n", F.col("t").alias("u")), "n", ("k", "o"), ("t", "u"), lambda a, b: 0 * a * b).collect()


def test_blocks_are_counted_without_pairs(spark, alike, odd, tmp_path):
    assert [tuple(r) for r in queries.block_candidates(spark, alike).select("c_nationkey", "n", "first_customer", "last_supplier").collect()] == [(1, N * N, 0, 1009 * (N - 1))]
    same(spark, odd, "block_candidates")
    rows = [(k, None if k == 3 else k % 2, 1.0) for k in range(4)]
    same(spark, tables(spark, tmp_path, [(k, k % 5, 1.0) for k in range(20)], rows), "block_candidates")
    same(spark, tables(spark, tmp_path / "empty", rows, []), "block_candidates")
