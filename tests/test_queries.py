"""Every core query: the same rows as its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from docev.functions import fuzzy
from docev.plans import cases, lookups, mechanisms, queries  # noqa: F401, register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def base(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, base, small, name):
    frame = queries.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    expected = base.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in frame.select(*columns).collect())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_pairs_are_a_greedy_pass(spark, small):
    pairs = [(r.c_custkey, r.s_suppkey, r.score) for r in queries._pairs(spark, small).select("c_custkey", "s_suppkey", "score").collect()]
    left, right, expected = set(), set(), set()
    for c, s, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if c not in left and s not in right:
            expected.add((c, s, score))
            left.add(c)
            right.add(s)
    assert {tuple(r) for r in queries.greedy_pairs(spark, small).select("c_custkey", "s_suppkey", "score").collect()} == expected


def test_fuzzy_pairs(spark, small):
    names = sorted({r.p_name for r in spark.read.parquet(f"{small}/part.parquet").collect()})
    key = lambda x: "".join(c for c in x if c.isascii() and c.isalnum()).lower()
    expected = {(a, b) for a in names for b in names if a < b and a[:1] == b[:1] and fuzzy.similar(key(a), key(b)) >= 60}
    assert {(r.p_name, r.other) for r in queries.fuzzy_pairs(spark, small).collect()} == expected


def test_bootstrap_is_the_same_again(spark, small):
    one, two = (sorted(queries.bootstrap_interval(spark, small).collect()) for _ in range(2))
    assert one == two and all(r.low <= r["mean"] <= r.high for r in one)
