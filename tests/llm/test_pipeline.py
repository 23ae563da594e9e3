"""The pipeline against a plain version of every stage, over the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from docev.llm import common, decontam, jaccard, mixing, queries, rules, tokens
from tests.llm.test_operators import linked_classes, plain_lcs, repeated_words, resharing, words

ROOT = "/root/testdata/sf0.001"


def passes(text):
    w, raw = words(text), text or ""
    held = [x for x in raw.split("\n") if words(x)]
    symbols, size = len(re.findall(r"[#*$%&|<>]", raw)), sum(map(len, w))
    return not (
        len(w) < 20 or 100 * repeated_words(w) > 30 * len(w) or symbols * 2 > len(w) or raw.count("!") * 2 > len(w) or size < 2 * len(w) or size > 30 * len(w)
        or (len(held) - len(set(held))) * 2 > len(held)
    )


def terms(text):
    return [t for t in (w.lower().strip(decontam.MARKS) for w in words(text)) if t]


def holds(text, items):
    """Whether an item's terms stand in order, with few gaps, somewhere in the text."""
    mine = terms(text)
    for item in items:
        n = len(item)
        known = set(item)
        for start in range(0, max(1, len(mine)), 16):
            around = mine[start : start + n + 48]
            if sum(t in known for t in around) >= decontam.LCS * n and plain_lcs(item, around) >= decontam.LCS * n:
                return True
    return False


def copies(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets = resharing(sizes)
    out = []
    for i, text, source in rows:
        rate = targets[source] / sizes[source] if sizes[source] else 0
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [(i, text)] * (int(rate) + (draw < rate - int(rate)))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, each on what the one before it kept."""
    from docev.llm import common

    stage, docs = common.Stage(spark, "stages"), spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [docs]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out.append(stage.table(str(k), step(spark, out[-1], ROOT)))
    return out


def rows_of(frame):
    return sorted((r.doc_id, r.text, r.source) for r in frame.collect())


def test_stages_are_those_asked_for():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_files"]
    assert set(rules.POLICIES["base"]) <= set(rules.POLICIES[rules.PRODUCTION])


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_rules(stages):
    assert rows_of(stages[1]) == [r for r in rows_of(stages[0]) if passes(r[1])]


def test_near_duplicates(stages):
    rows = rows_of(stages[1])
    first = {i for i, least, _ in linked_classes([(i, t) for i, t, _ in rows]) if i == least}
    assert rows_of(stages[2]) == [r for r in rows if r[0] in first]


def test_decontamination(spark, stages):
    items = [terms(r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    rows = rows_of(stages[2])
    assert rows_of(stages[3]) == [r for r in rows if not holds(r[1], items)]


def test_mixture(stages):
    assert sorted((i, t) for i, t, _ in rows_of(stages[4])) == sorted(copies(rows_of(stages[3])))


def test_token_files(spark, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    expected, at = [], 0
    for i, text, _ in rows_of(stages[4]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in stages[5].collect()) == sorted(expected)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, ROOT).collect()) == sorted(stages[5].collect())


def test_odd_rows_go_through(spark):
    prose = " ".join(f"word{k % 61}x{k % 7}" for k in range(80))
    rows = [(1, prose, "a"), (1, prose, "a"), (2, prose, None), (None, prose + " tail", "a"), (3, None, "b"), (4, "", None), (5, "word " * 5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for given, least in ((docs, 1), (docs.limit(0), 0)):
        kept = given
        for _, step in corpus_pipeline.STAGES:
            kept = step(spark, kept, ROOT)
        assert kept.count() >= least
    near = corpus_pipeline.near_duplicates(spark, docs, ROOT)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5)]


def test_clean_rows_stay_beside_leaks(spark):
    item = max((r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()), key=lambda t: len(words(t)))
    prose = " ".join(f"word{k % 61}x{k % 7}" for k in range(80))
    clean = [(None, f"{prose} {k}", "a") for k in range(20)] + [(7, prose, "a"), (None, None, "a"), (8, "", "a")]
    leaks = [(None, f"{prose} {item} {prose}", "a"), (7, f"{item} {prose}", "a")]
    docs = spark.createDataFrame(clean + leaks, "doc_id long, text string, source string")
    kept = [tuple(r) for r in corpus_pipeline.decontamination(spark, docs, ROOT).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, clean))


def test_near_duplicates_without_ids_or_with_repeated_ones(spark):
    prose = lambda x, n=80: " ".join(f"{x}{k % 61}x{k % 7}" for k in range(n))
    rows = [(None, prose("a")), (None, prose("a")), (None, prose("a") + " tail"), (None, prose("b")), (None, prose("c") + " tail"), (5, prose("c")), (6, prose("d")), (6, prose("e")), (6, prose("e")), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    found = [tuple(r) for r in jaccard.join(docs, common.Stage(spark, "odd")).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, linked_classes(rows)))
    kept = [r.text[:1] if r.text else r.text for r in corpus_pipeline.near_duplicates(spark, docs, ROOT).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, ["a", "b", "c", "d", "e", None, ""]))
    again = [r.text[:1] if r.text else r.text for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), ROOT).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, kept))


def test_columns_of_the_operators_own_names_come_through(spark):
    prose = lambda x: " ".join(f"{x}{k % 61}x{k % 7}" for k in range(80))
    extra = {"mix_size": "a", "mix_source": "b", "ql_words": "keep", "ql_note": "note", "whole_row": "c", "row": "d", "class_id": "e", "found_key": "f", "__key": "g", "n": "h", "a.b": "i"}
    rows = [(k, prose(f"t{k}"), "s", *extra.values()) for k in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *extra])
    kept = docs
    for _, step in corpus_pipeline.STAGES[:4]:
        kept = step(spark, kept, ROOT)
        assert kept.columns == docs.columns
        found = [tuple(r) for r in kept.collect()]
        assert found and set(found) <= set(rows)
