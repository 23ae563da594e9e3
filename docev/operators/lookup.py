"""Lookups by containment: the first, or the best, of many texts that holds a key.

Keys are a query set: distinct, in counted blocks that are small enough to broadcast, each one automaton. Texts are read
once a block, in Arrow batches, and each is told all the keys it holds in one pass over its characters; a task keeps the
best text of each key only, so what leaves it is bounded by the block, however many texts hold a common key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import fuzzy
from . import link

#: Characters that keys of companies are made of.
CJK = r"[^一-鿿]"
EXACT = 101.0


def _search(block):
    """The best (measure, place) of each key in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, automaton = block.value
        best: dict[int, tuple] = {}
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("place").type
            for x, mine in zip(batch.column("x").to_pylist(), zip(batch.column("measure").to_pylist(), batch.column("place").to_pylist(), strict=True), strict=True):
                for number in {number for _, number in automaton.iter(x)}:
                    if number not in best or mine < best[number]:
                        best[number] = mine
        told = list(best.items())
        columns = [pa.array([keys[k] for k, _ in told], pa.string()), pa.array([m for _, (m, _) in told], pa.int64()), pa.array([p for _, (_, p) in told], kind)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "measure", "place"])

    return run


def _automaton(keys: Sequence[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, key in enumerate(keys):
        made.add_word(key, number)
    made.make_automaton()
    return made


def first_holders(keys: DataFrame, texts: DataFrame, block_rows: int = link.BLOCK_ROWS) -> DataFrame:
    """Each distinct key with the text that holds it and comes first: key, measure and place of the least (measure, place)
    among texts (x, measure long, place). Keys that no text holds, and null and empty keys, are left out, null texts
    hold none; places are unique and not null (repeats are one place)."""
    asked = keys.select("key").where("key is not null and key != ''").distinct()
    schema = f"key string, measure long, place {texts.schema['place'].dataType.simpleString()}"
    held = texts.where("x is not null and x != '' and measure is not null and place is not null").select("x", F.col("measure").cast("long").alias("measure"), "place")
    found = []
    for block in link.blocks(asked, "key", rows=block_rows):
        told = [r.key for r in block.collect()]  # a counted block
        if told:
            sent = keys.sparkSession.sparkContext.broadcast((told, _automaton(told)))
            found.append(held.mapInArrow(_search(sent), schema))
    if not found:
        return keys.sparkSession.createDataFrame([], schema)
    best = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min(F.struct("measure", "place")).alias("b"))
    return best.select("key", "b.measure", "b.place")


def company_key(name: Column, head: int = 15, size: int = 6, least: int = 3, other: str = CJK) -> Column:
    """The first letters in the head of a company's name, or null if there are too few; ``other`` is what is no letter."""
    letters = F.regexp_replace(F.substring(name, 1, head), other, "")
    return F.when(F.length(letters) >= least, F.substring(letters, 1, size))


def by_company(entries: DataFrame, projects: DataFrame, key: Column, names: tuple[str, str], place: str) -> DataFrame:
    """Entries with the project, one of whose two names holds their key, that the key covers most of: found (its place),
    the first of equals, and score, the key's share of the shorter name. Both are null if none holds it. An empty or
    missing name counts as one character."""
    length = F.least(*[F.greatest(F.length(F.coalesce(F.col(n), F.lit(""))), F.lit(1)) for n in names]).alias("measure")
    texts = [projects.select(F.col(n).alias("x"), length, F.col(place).alias("place")) for n in names]
    rows = entries.withColumn("__key", key)
    best = first_holders(rows.select(F.col("__key").alias("key")), texts[0].unionByName(texts[1]))
    found = rows.join(best, F.col("__key") == F.col("key"), "left")
    return found.select(*entries.columns, F.col("place").alias("found"), (F.length("__key") / F.col("measure")).alias("score"))


def by_file_name(rows: DataFrame, files: DataFrame, key: Column, name: str, place: str, tail: int = 6) -> DataFrame:
    """Rows with the first file whose name holds their key, else, of a key longer than ``tail``, its last characters: found
    (the file's place) and how, 'key', 'tail' or 'none'. An empty key is in every name, so it finds the first file of
    all; a null key finds none."""
    texts = files.select(F.col(name).alias("x"), F.lit(0).cast("long").alias("measure"), F.col(place).alias("place"))
    keyed = rows.withColumn("__key", key).withColumn("__tail", F.when(F.length("__key") > tail, F.substring("__key", -tail, tail)))
    best = session.checkpointed(first_holders(keyed.select(F.explode(F.array("__key", "__tail")).alias("key")), texts).select("key", "place"))
    first = files.where(F.col(name).isNotNull()).agg(F.min(place).alias("__any"))  # one row
    told = lambda n: best.select(F.col("key").alias(f"__k{n}"), F.col("place").alias(f"__p{n}"))
    found = keyed.join(told(1), F.col("__key") == F.col("__k1"), "left").join(told(2), F.col("__tail") == F.col("__k2"), "left").crossJoin(F.broadcast(first))
    whole = F.when(F.col("__key") == "", F.col("__any")).otherwise(F.col("__p1"))
    how = F.when(whole.isNotNull(), "key").when(F.col("__p2").isNotNull(), "tail").otherwise("none")
    return found.select(*rows.columns, F.coalesce(whole, F.col("__p2")).alias("found"), how.alias("how"))


def by_ways(left: DataFrame, right: DataFrame, ident: str, place: str, equal: tuple[Column, Column], ways: Sequence[tuple[Column, Column, float]], alike: tuple[Column, Column, float] | None = None) -> DataFrame:
    """ident, found and score: the best right row (its place) of each left row by several ways. Equal names score 100 and
    end the search; each way is a key that a right text holds, and its score; ``alike``, two short names and a bound,
    scores names by ``partial_similarity`` above it. The highest score wins, the first place of equals; rows without any
    way have no found and score 0. ``alike`` compares all distinct names that share enough of their rarest characters: give
    it where distinct names are few."""
    rows = session.checkpointed(left.select(ident, equal[0].alias("__equal"), *[mine.alias(f"__k{k}") for k, (mine, _, _) in enumerate(ways)], *([] if alike is None else [alike[0].alias("__like")])))
    hit = lambda frame, rank, score: frame.select(F.col(ident), "place", rank.alias("rank"), score.alias("score"))
    names = right.select(equal[1].alias("name"), F.col(place).alias("place")).where("name is not null and name != ''").groupBy("name").agg(F.min("place").alias("place"))
    found = hit(rows.join(names, F.col("__equal") == F.col("name")), F.lit(EXACT), F.lit(100.0))
    for k, (_, held, score) in enumerate(ways):
        texts = right.select(held.alias("x"), F.lit(0).cast("long").alias("measure"), F.col(place).alias("place"))
        best = first_holders(rows.select(F.col(f"__k{k}").alias("key")), texts)
        found = found.unionByName(hit(rows.join(best, F.col(f"__k{k}") == F.col("key")), F.lit(float(score)), F.lit(float(score))))
    if alike is not None:
        firsts = right.select(alike[1].alias("b"), F.col(place).alias("place")).groupBy("b").agg(F.min("place").alias("place"))
        pairs = link.similar_names(rows.select(F.col("__like").alias("a")), firsts.select("b"), "a", "b", alike[2], form=lambda c: c, measure=fuzzy.partial_similarity)
        scored = pairs.withColumn("score", fuzzy.partial_similarity("a", "b")).where(F.col("score") > alike[2]).join(firsts, "b")
        best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("score"), "place")).alias("m")).select("a", (-F.col("m.score")).alias("s"), "m.place")
        found = found.unionByName(hit(rows.join(best, F.col("__like") == F.col("a")), F.col("s"), F.col("s")))
    best = found.groupBy(ident).agg(F.min(F.struct((-F.col("rank")).alias("rank"), "place", "score")).alias("m")).select(F.col(ident).alias("__i"), F.col("m.place").alias("found"), F.col("m.score").alias("score"))
    return rows.select(ident).join(best, F.col(ident) == F.col("__i"), "left").select(ident, "found", F.coalesce("score", F.lit(0.0)).alias("score"))
