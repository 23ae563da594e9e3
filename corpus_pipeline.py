"""A training-corpus pipeline: each stage calls one operator on all rows its predecessor kept.

Stages take (spark, docs, sf_dir) and return the rows kept, with the columns of documents; the last
returns what its files hold. Rows are told apart by themselves, not by doc_id: ids may be null, repeat
or stand on different texts. Operators see the columns they need and a struct of the row, so that extra
columns of any name come through as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docev.llm import common, decontam, jaccard, mixing, queries, rules, tokens


def held(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, and the whole row."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the production policy."""
    return rules.apply_policy(rules.ledger(held(docs, "doc_id", "text"))).where("ql_kept").select("whole_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the row with the smallest id, one without an id only if none has
    one. Texts without words are classes of their own. Prefixes have the length that finds a pair at the
    threshold by itself, not one estimated from the links found."""
    stage = common.Stage(spark, "near")
    rows = stage.table("rows", held(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    classes = jaccard.join(rows.select("row", "text"), stage, doc_id="row", depth=jaccard.certain()).select(F.col("doc_id").alias("row"), "class_id")
    told = stage.table("classes", rows.select("row", "doc_id").join(classes, "row"))
    first = told.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select("first.row").hint("merge"), "row", "left_semi").select("whole_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, each told by the 128-bit digest of its own text."""
    told = docs.select(common.text_key(F.col("text")).alias("doc_id"), "text")
    found = decontam.find(told, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), common.Stage(spark, "leaks"), key=T.BinaryType())
    leaks = found.select(F.col("doc_id").alias("found_key")).distinct().checkpoint()
    leaks = F.broadcast(leaks) if leaks.count() <= common.BROADCAST_ROWS else leaks.hint("merge")
    rows = held(docs, "text")
    return rows.join(leaks, common.text_key(rows["text"]) == leaks["found_key"], "left_anti").select("whole_row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's rates give them."""
    return mixing.emit(mixing.plan(held(docs, "doc_id", "text", "source"))).select("whole_row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token files, read back: doc_id, start, n_tokens and ids_crc32."""
    written = tokens.write(docs, queries.tokenizer_path(), common.Stage(spark, "corpus"))
    return tokens.read(*written, with_ids=False).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token files", token_files),
]

#: Tokens, latent vectors and the forest aren't SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes a table that the next reads."""
    stage = common.Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.table(str(k), docs)
    return docs
