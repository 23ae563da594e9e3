"""Plans: what is read, what is pushed to the scan, and where Python runs."""

from __future__ import annotations

import re

import pytest

from docev.plans import cases, mechanisms, queries  # noqa: F401, register their queries

#: Queries with an Arrow step that no built-in function has.
PYTHON = {"fuzzy_pairs", "greedy_pairs", "vendor_clients", "pdf_pages", "claim_trace", "wilcoxon", "wilcoxon_groups", "bootstrap_interval", "amount_intervals"}


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def columns_read(text):
    return {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", schema)}


@pytest.mark.parametrize(("name", "columns"), [
    ("doc_class_counts", {"text"}), ("share_bands", {"l_orderkey", "l_partkey", "l_returnflag", "p_partkey", "p_brand"}), ("pivot_matrix", {"o_custkey", "o_orderstatus", "c_custkey", "c_mktsegment"}),
    ("membership_tier", {"doc_id", "quality", "toxic"}), ("last_wins_lookup", {"o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"}), ("audit_tiers", {"doc_id", "text", "lang", "quality"}),
])
def test_only_needed_columns_are_read(spark, small, name, columns):
    assert columns_read(plan(queries.QUERIES[name](spark, small))) == columns


def test_filters_reach_the_scan(spark, small):
    assert "GreaterThan(n_chars,1000)" in plan(queries.sql_like_terms(spark, small)) and "EqualTo(o_orderstatus,F)" in plan(queries.unmatched(spark, small))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - PYTHON))
def test_no_python_and_no_product(spark, small, name):
    text = plan(queries.QUERIES[name](spark, small))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroups|MapInArrow|MapInPandas|CartesianProduct", text)


def test_aggregates_combine_before_the_shuffle(spark, small):
    text = plan(queries.doc_class_counts(spark, small))
    assert text.count("HashAggregate") >= 2 and "partial_count" in text


@pytest.mark.parametrize("name", ["title_fallback_join", "mutual_best", "unmatched", "duplicate_sources"])
def test_lookups_are_equal_joins(spark, small, name):
    assert "NestedLoop" not in plan(queries.QUERIES[name](spark, small))
