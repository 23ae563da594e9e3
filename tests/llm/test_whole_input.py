"""Operators that fit a model read all texts for it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from docev.llm import common, decontam


def test_latent_vectors_are_fitted_on_all_texts(spark, monkeypatch):
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta "), F.col("id").cast("string")).alias("text"))
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    seen, singular = [], decontam.singular
    monkeypatch.setattr(decontam, "singular", lambda terms, *rest: seen.append(terms.count()) or singular(terms, *rest))
    assert decontam.find(docs, items, common.Stage(spark, "whole")).count() == 0
    assert seen == [45_000]


def test_the_pipeline_fits_on_all_texts(spark, monkeypatch, small):
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("text"))
    seen, singular = [], decontam.singular
    monkeypatch.setattr(decontam, "singular", lambda terms, *rest: seen.append(terms.count()) or singular(terms, *rest))
    assert corpus_pipeline.decontamination(spark, docs, small).count() == 45_000
    assert seen == [45_000]


def test_latent_vectors_are_fitted_on_all_passages(monkeypatch):
    """Against the dense product over the half-overlapping passages that the search projects."""
    draw = np.random.default_rng(6)
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 100)
    monkeypatch.setattr(decontam, "DENSE_TERMS", 20)
    size, kind = 61, np.dtype("<u2")
    texts = [draw.integers(0, size, int(n)).astype(kind) for n in (0, 1, 32, 33, 64, 65, 96, 97, 400, 1000, 5)] + [np.zeros(70, kind)]
    idf = np.concatenate([[0], draw.random(size - 1) + 0.1]).astype(np.float32)
    against = draw.standard_normal((size, 7)).astype(np.float32)
    batch = pa.RecordBatch.from_pydict({"terms": pa.array([t.tobytes() for t in texts], pa.binary())})
    found = np.zeros(against.shape)
    for part in decontam._gathered(kind, idf, against)(iter([batch])):
        rows = np.frombuffer(part.column("sums")[0].as_py(), np.float64).reshape(-1, 7)
        found[part.column("segment")[0].as_py() :][: len(rows)] += rows
    passages = np.concatenate([decontam.passages_of(decontam.blocks_of(t, np.diag(idf))) for t in texts if len(t)])
    passages = decontam._unit(passages)
    assert np.allclose(found, passages.T @ (passages @ against), rtol=1e-4, atol=1e-4)


def test_the_pipeline_takes_no_depth_from_the_links_found(spark):
    """Many close texts make the pairs at the threshold a small share of the links found; all of them are duplicates."""
    words = lambda name, n, *changed: " ".join(f"{name}x{j}" if j in changed else f"{name}w{j}" for j in range(n))
    close = [words("c", 200).replace(f"cw{k} ", f"cx{k} ") for k in range(198)]
    pairs = [words(f"p{k}", 94, *changed) for k in range(800) for changed in ((), (30, 60))]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(close + pairs)], "doc_id long, text string, source string").repartition(8)
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1 + 800
