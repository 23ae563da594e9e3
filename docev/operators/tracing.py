"""Claims traced to the lines that support them, by an automaton of all their pieces.

A block of claims (counted, and bounded in rows and bytes) becomes one Aho-Corasick automaton, which is broadcast;
every line is read once a block, in Arrow batches, and finds all pieces it holds in one pass over its characters. A claim
is looked at only where a line holds several of its rarest pieces, which every line that supports it must hold.
Claims of one text are traced once. A task takes its lines in order of preference, so a claim is done at its first one and
isn't looked at again; what leaves a task is bounded by the block however many lines repeat a boilerplate: no line is
joined to a claim.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import match, text
from . import link

_BEST = "claim string, project string, rank int, source_type string, source_file string, line_start long, quote string"
_LINE = ("source_type", "source_file", "line_start", "quote")


class Claims:
    """A block of claims: distinct texts with their pieces, and the projects that each is asked for."""

    def __init__(self, rows: Sequence[tuple[str, str, list[str], int]]):
        self.texts: list[str] = []
        self.needs: list[int] = []
        self.projects: list[set[str]] = []
        at: dict[str, int] = {}
        held: dict[str, Counter] = {}
        for claim, project, pieces, need in rows:
            if claim not in at:
                at[claim] = len(self.texts)
                self.texts.append(claim)
                self.needs.append(need)
                self.projects.append(set())
                for piece, times in Counter(pieces).items():
                    held.setdefault(piece, Counter())[at[claim]] += times
            self.projects[at[claim]].add(project)
        self.known = sorted(set().union(*self.projects)) if self.projects else []
        numbers = {piece: k for k, piece in enumerate(held)}
        self.pieces: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, number in numbers.items():
            self.automaton.add_word(piece, number)
        if held:
            self.automaton.make_automaton()
        # How common a piece is: in how many of the claims it occurs, within other words too, as it does in lines.
        common = Counter(number for claim in self.texts for number in {number for _, number in self.automaton.iter(claim)}) if held else Counter()
        for piece, claims in sorted(held.items(), key=lambda h: (common[numbers[h[0]]], numbers[h[0]])):  # the rarest first
            for claim, times in claims.items():
                self.pieces[claim].append((numbers[piece], times))
        # A line with enough of a claim's pieces has some of its rarest: if all but so many of them are left out, it has
        # at least the number needed less what is left out.
        self.postings: dict[int, list[int]] = {}
        self.least: list[int] = []
        for claim, mine in enumerate(self.pieces):
            total, need = sum(times for _, times in mine), self.needs[claim]
            self.least.append(max(1, need // 3))
            left = total - need + self.least[claim]
            for number, times in mine:
                if left <= 0:
                    break
                self.postings.setdefault(number, []).extend([claim] * times)
                left -= times

    def supported(self, line: str, done: bytearray) -> list[int]:
        """The texts not yet done that have enough of their pieces in a line."""
        if not self.postings:
            return []
        found = {number for _, number in self.automaton.iter(line)}
        near = Counter(chain.from_iterable(self.postings[number] for number in found if number in self.postings))
        near_enough = [claim for claim, n in near.items() if n >= self.least[claim] and not done[claim]]
        return [claim for claim in near_enough if sum(times for number, times in self.pieces[claim] if number in found) >= self.needs[claim]]

    def fitting(self, project: str) -> list[str]:
        """The projects whose claims a line of this project may support."""
        return [p for p in self.known if p == "" or p in project or project in p]


def _trace(block, guarded: frozenset[str]):
    """Lines in order: the first that supports a text, for everyone or for a project, is the task's best, and a text is done
    once all its projects have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims: Claims = block.value
        done, missing = bytearray(len(claims.texts)), [set(p) for p in claims.projects]
        best: list[tuple] = []
        fitting: dict[str, set[str]] = {}
        for batch in batches:
            for rank, kind, file, project, start, quote in zip(*(batch.column(c).to_pylist() for c in ("rank", "source_type", "source_file", "line_project", "line_start", "quote")), strict=True):
                mine = project or ""
                everyone = kind not in guarded or not mine
                if not everyone and mine not in fitting:
                    fitting[mine] = set(claims.fitting(mine))
                for claim in claims.supported(quote, done):
                    asked = missing[claim] if everyone else missing[claim] & fitting[mine]
                    best += [(claims.texts[claim], p, rank, kind, file, start, quote) for p in ([None] if everyone else asked)]
                    missing[claim] = missing[claim] - asked
                    done[claim] = not missing[claim]
        names = ["claim", "project", "rank", *_LINE]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in best], t) for k, t in enumerate(types)], names)

    return run


def traced(claims: DataFrame, lines: DataFrame, priority: Mapping[str, int], guarded: Sequence[str] = ("report", "approval"), least: int = 2, block_rows: int = link.BLOCK_ROWS) -> DataFrame:
    """Each claim (qa_id, claim, project_id) with the first line that supports it, by source priority, file and line: a
    line (source_type, source_file, project_id, line_start, text) that holds enough of its pieces. A line of another
    project doesn't support a claim where its type is guarded, a line of no project may; a line of a historical case
    supports it indirectly. Claims under four characters are never supported."""
    pieces = match.claim_pieces(F.col("claim"))
    need = F.greatest(F.lit(least), F.floor(F.size("pieces") * 0.6).cast("int"))
    asked = claims.select("claim", text.default(F.col("project_id")).alias("project")).distinct().withColumn("pieces", pieces).where(F.size("pieces") > 0)
    asked = asked.where(F.size("pieces") >= need).withColumn("need", need)  # others can't be supported
    rank = text.looked_up(F.col("source_type"), {k: str(v) for k, v in priority.items()}).cast("int")
    held = lines.select(rank.alias("rank"), "source_type", "source_file", F.col("project_id").alias("line_project"), F.col("line_start").cast("long").alias("line_start"), F.col("text").alias("quote"))
    found = None
    for block in link.blocks(asked, "claim", "project", "pieces", rows=block_rows):
        sent = claims.sparkSession.sparkContext.broadcast(Claims([(r.claim, r.project, r.pieces, r.need) for r in block.collect()]))  # a counted block
        best = held.where("quote is not null").sortWithinPartitions("rank", "source_file", "line_start").mapInArrow(_trace(sent, frozenset(guarded)), _BEST)
        found = best if found is None else found.unionByName(best)
    order = F.struct("rank", "source_file", "line_start")
    first = found.groupBy("claim", "project").agg(F.min_by(F.struct("rank", *_LINE), order).alias("s"))
    # A text's lines of its own project, and those that stand for every project.
    own = first.where("project is not null").select(F.col("claim").alias("c1"), "project", F.col("s").alias("s1")).hint("merge")
    every = first.where("project is null").select(F.col("claim").alias("c2"), F.col("s").alias("s2")).hint("merge")
    rows = claims.withColumn("asked", text.default(F.col("project_id")))
    rows = rows.join(own, (rows["claim"] == own["c1"]) & (rows["asked"] == own["project"]), "left").join(every, F.col("claim") == F.col("c2"), "left")
    of = lambda s: F.struct(F.col(f"{s}.rank"), F.col(f"{s}.source_file"), F.col(f"{s}.line_start"))
    s = F.when(F.col("s2").isNull() | (F.col("s1").isNotNull() & (of("s1") <= of("s2"))), F.col("s1")).otherwise(F.col("s2"))
    support = F.when(F.col("s.source_type") == "historical_case", "indirect").when(F.col("s").isNotNull(), "direct").otherwise("unsupported")
    return rows.withColumn("s", s).withColumn("support", support).select(*claims.columns, "support", *[f"s.{c}" for c in _LINE])
