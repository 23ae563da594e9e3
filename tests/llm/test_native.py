"""The operators marked native run no Python, and no operator multiplies rows out."""

from __future__ import annotations

import re

import pytest

from docev.llm import common, lines, mixing, queries, rules
from tests.test_explain import plan

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_line_dedup", "op5_quality_rules"])
def test_native_queries(spark, name):
    assert not re.search("Python|Pandas|MapInArrow|FlatMapGroups|CartesianProduct|NestedLoop", plan(queries.queries()[name](spark, ROOT)))


def test_native_emission_and_policies(spark):
    docs = common.documents(spark, ROOT)
    for frame in (mixing.emit(mixing.plan(docs)), rules.apply_policy(rules.ledger(docs)).where("ql_kept"), rules.ablation(rules.ledger(docs)), lines.dedup(spark.read.parquet(f"{ROOT}/pages.parquet"), common.Stage(spark, "t"))):
        assert not re.search("Python|Pandas|MapInArrow|FlatMapGroups|CartesianProduct|NestedLoop", plan(frame))


def test_texts_are_read_once_in_the_ledger(spark):
    text = plan(rules.ledger(common.documents(spark, ROOT).select("doc_id", "text")))
    assert text.count("Scan parquet") <= 2 and "Exchange" not in text
