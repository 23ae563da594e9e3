"""Operator 13: conversation structure repair by dynamic programming over time-major tensors.

A conversation's rows are edited, at the least cost, so that its roles' initials read ``(s?(ua)+)?``: Keep (0),
Rerole to user or assistant (3), Delete (4, required for blank and duplicate rows), Insert an empty user or
assistant row anywhere (3); a truncated row that stays adds 3. Of the cheapest edits those with the ASCII-least
string of initials are taken.

Rows are dealt to ranges of (conversation, turn) and numbered in order; ``BLOCK`` numbers are a block, which one
task holds. In a block conversations are put in buckets by length (powers of two), and each bucket is a tensor
[turn, state, conversation]: every step updates all conversations' costs of the four states (start, after system,
user, assistant) from the last turn to the first, and the stored costs lead the traces of all of them forward.

A conversation that crosses blocks is solved exactly in parts: each part gives its costs from state to state, the
parts' costs are combined from the last to the first, each part is traced from every state it may be entered in, and
the chain of entries picks one trace. So a conversation of any length takes the memory of a block.

Defined results: a null role or text is one space; rows go by turn, nulls first, then by role and by a digest of
role and text; a row's first fault counts: blank (no character but space and tab to carriage return), duplicate (role
and text of an earlier row, told by 128 bits), truncated (its last other character isn't ``.``, ``!`` or ``?``); roles
of other initials can't be kept; null conversation ids are one conversation; an empty table gives no rows; extra
columns are not read. Texts are never collected: they are joined to the edits by row. ``audits`` streams a
conversation's repaired rows through a hash in order, so one task reads a conversation, a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_BITS = 12
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: start, after system, after user, after assistant. What a user or assistant row leads to, and what a kept
#: row of initial s, u, a or another one leads to; -1: not allowed.
TOLD = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs of ending in a state: after a system row a user and an assistant row are missing, after a user row the latter.
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
NEVER = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by a hash of conversation and turn: of twenty, one drops the row, one
    empties its text, one takes its end marks, one repeats it, one makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), drawn.alias("draw")).where("draw != 0")
    body = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame, stage: common.Stage) -> DataFrame:
    """The rows with ``place``, which orders those of a conversation, and what the faults need."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    conversation = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    key = common.text_key(F.concat(conversation, F.lit(":"), F.length("role"), F.lit(":"), "role", "text"))
    body = F.rtrim("text", F.lit(SPACES))
    told = rows.withColumn("key", key).withColumn("blank", body == "").withColumn("cut", ~F.right(body, F.lit(1)).isin(".", "!", "?"))
    told = told.withColumn("draw", F.xxhash64(F.monotonically_increasing_id()))  # parts equal rows
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "key", "draw"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = told.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    return stage.table("placed", placed.drop("draw"))


def faults(placed: DataFrame) -> DataFrame:
    """conv_id, place, turn, block, role's initial and fault of each row."""
    first = placed.groupBy("key").agg(F.min("place").alias("first")).hint("merge")
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = placed.select("conv_id", "turn", "place", "key", "role", "blank", "cut").join(first, "key")
    return rows.select("conv_id", "place", F.shiftright("place", BLOCK_BITS).alias("block"), code.cast("byte").alias("initial"), fault.cast("byte").alias("fault"))


# --- the tensors -----------------------------------------------------------------------------


def backward(initial: np.ndarray, fault: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs [turn, state, conversation] of finishing before each turn. Conversations stand at the tensors' ends: the
    first turns of shorter ones are padding. ``ends`` is [state, conversation]."""
    turns, n = initial.shape
    costs = np.empty((turns + 1, 4, n), np.int64)
    costs[turns] = ends
    for t in range(turns - 1, -1, -1):
        after, cut = costs[t + 1], np.where(fault[t] == TRUNCATED, CUT, 0)
        stays = np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), NEVER, cut)
        to = KEPT[:, initial[t]]
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 0), NEVER)
        now = np.minimum(after + DELETE, np.minimum(kept, after[TOLD] + REROLE) + stays)
        once = np.minimum(now, now[TOLD] + INSERT)
        now = np.minimum(once, once[TOLD] + INSERT)
        costs[t] = np.where(t >= turns - lengths, now, after)
    return costs


def traced(initial: np.ndarray, fault: np.ndarray, lengths: np.ndarray, costs: np.ndarray, entry: np.ndarray, last: np.ndarray):
    """The ASCII-least cheapest edits of all conversations, a step of all of them at a time: arrays of conversation,
    turn (of the row, or -1), edit and state after it, in order of steps; and the states in which they end."""
    turns, n = initial.shape
    at, state, live = turns - lengths, entry.copy(), np.arange(n)
    out = []
    while len(live):
        t, s = at[live], state[live]
        more = t < turns
        # The end of a last part is the end of the conversation: rows may still be missing there.
        on = more | (last[live] & (costs[turns, s, live] > 0))
        live, t, s, more = live[on], t[on], s[on], more[on]
        if not len(live):
            break
        here, row = costs[t, s, live], np.minimum(t, turns - 1)
        f = fault[row, live] if turns else np.zeros(len(live), np.int8)
        to = KEPT[s, initial[row, live]] if turns else np.full(len(live), -1)
        stays, following = more & (f != BLANK) & (f != DUPLICATE), np.minimum(t + 1, turns)
        delete = more & (costs[following, s, live] + DELETE == here)
        insert = ~delete & (costs[t, TOLD[s], live] + INSERT == here)
        keep = ~delete & ~insert & stays & (to >= 0) & (costs[following, np.maximum(to, 0), live] + np.where(f == TRUNCATED, CUT, 0) == here)
        edit = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R"))
        after = np.where(delete, s, np.where(keep, to, TOLD[s]))
        out.append((live, np.where(insert, -1, t), edit, after))
        state[live], at[live] = after, np.where(insert, t, following)
    done = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return *done, state


def _runs(table: pa.Table):
    """The columns of a block in order, and where its conversations begin."""
    table = table.sort_by("place")
    code = pc.dictionary_encode(table.column("conv_id").combine_chunks(), null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return table, table.column("initial").to_numpy().astype(np.int64), table.column("fault").to_numpy(), starts, np.diff(np.append(starts, len(code)))


def _buckets(starts: np.ndarray, lengths: np.ndarray, initial: np.ndarray, fault: np.ndarray):
    """Conversations of like length: their indices, and the tensors' [turn, conversation] columns, with rows' positions."""
    width = np.left_shift(1, np.ceil(np.log2(lengths)).astype(np.int64))
    for w in np.unique(width).tolist():
        who = np.flatnonzero(width == w)
        position = starts[who][None, :] + np.arange(w)[:, None] - (w - lengths[who])[None, :]
        position = np.maximum(position, starts[who][None, :])
        yield who, position, initial[position], fault[position]


def _ends_of(ident: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", ident), T.StructField("block", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType()))])


def _crossing(table: pa.Table) -> pa.Table:
    """Costs from state to state of a block's first and last conversations, which others may go on with."""
    table, initial, fault, starts, lengths = _runs(table)
    edge = np.unique([0, len(starts) - 1])
    out = []
    for e in edge.tolist():
        rows = slice(starts[e], starts[e] + lengths[e])
        ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
        four = np.repeat(initial[rows, None], 4, 1), np.repeat(fault[rows, None], 4, 1)
        out.append(np.minimum(backward(*four, np.full(4, lengths[e]), ends)[0], NEVER).ravel().tolist())  # [from, to]
    ids = table.column("conv_id").combine_chunks().take(pa.array(starts[edge]))
    return pa.table([ids, table.column("block").combine_chunks().slice(0, len(edge)), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "block", "costs"])


def _chained(table: pa.Table) -> pa.Table:
    """For each part of a conversation but its last, the costs of finishing after it."""
    table = table.sort_by("block")
    costs = np.array(table.column("costs").to_pylist(), np.int64).reshape(-1, 4, 4)
    ends, out = ENDS, []
    for part in costs[:0:-1]:
        ends = (part + ends[None, :]).min(1)
        out.append(ends.tolist())
    kept = table.slice(0, len(out))
    return pa.table([kept.column("conv_id"), kept.column("block"), pa.array(out[::-1], pa.list_(pa.int64()))], names=["conv_id", "block", "costs"])


def _edited(ident: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("conv_id", ident), T.StructField("block", long), T.StructField("entry", T.ByteType()), T.StructField("step", long), T.StructField("place", long), T.StructField("edit", T.StringType()),
                         T.StructField("role", T.StringType()), T.StructField("cost", long), T.StructField("fault", T.ByteType()), T.StructField("initial", T.ByteType()), T.StructField("exit", T.ByteType())])


def _solved(table: pa.Table, known: pa.Table) -> pa.Table:
    """All edits of a block. ``known`` has costs after its last conversation if that goes on, and whether its first
    one began before: then it is traced from every state."""
    table, initial, fault, starts, lengths = _runs(table)
    goes_on = [c for c in known.column("costs").to_pylist() if c is not None]
    begun = any(known.column("begun").to_pylist())
    n = len(starts)
    entry, last, ends = np.zeros(n, np.int64), np.ones(n, bool), np.repeat(ENDS[:, None], n, 1)
    if goes_on:
        last[-1], ends[:, -1] = False, goes_on[0]
    who = np.arange(n)
    if begun:  # the first conversation, from its other states too
        who, entry = np.append(who, [0, 0, 0]), np.append(entry, [1, 2, 3])
    parts = []
    for bucket, position, its_initial, its_fault in _buckets(starts[who], lengths[who], initial, fault):
        w = who[bucket]
        costs = backward(its_initial, its_fault, lengths[w], ends[:, w])
        one, turn, edit, after, exits = traced(its_initial, its_fault, lengths[w], costs, entry[bucket], last[w])
        row = np.where(turn >= 0, position[np.maximum(turn, 0), one], -1)
        order = np.argsort(one, kind="stable")
        counts = np.bincount(one, minlength=len(bucket))
        step = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        one, row, edit, after = one[order], row[order], edit[order], after[order]
        parts.append((starts[w][one], entry[bucket][one], step, row, edit, after, exits[one]))
    head, entry, step, row, edit, after, exits = (np.concatenate(x) for x in zip(*parts, strict=True))
    place = table.column("place").to_numpy()
    its = np.where(row >= 0, fault[np.maximum(row, 0)], 0)
    cut = np.where(its == TRUNCATED, CUT, 0)
    cost = np.select([edit == ord("D"), edit == ord("I"), edit == ord("K")], [np.full(len(edit), DELETE), np.full(len(edit), INSERT), cut], REROLE + cut)
    told = (edit == ord("I")) | (edit == ord("R"))
    conversation = table.column("conv_id").combine_chunks().take(pa.array(head))
    block = np.full(len(edit), table.column("block")[0].as_py())
    letters, roles = pa.array([chr(e) for e in edit.tolist()], pa.string()), np.where(after == 2, "user", "assistant")
    return pa.table(
        [conversation, pa.array(block), pa.array(entry.astype(np.int8)), pa.array(step), pa.array(place[np.maximum(row, 0)], mask=row < 0), letters, pa.array(roles.tolist(), pa.string(), mask=~told), pa.array(cost),
         pa.array(its.astype(np.int8)), pa.array(initial[np.maximum(row, 0)].astype(np.int8), mask=row < 0), pa.array(exits.astype(np.int8))],
        names=["conv_id", "block", "entry", "step", "place", "edit", "role", "cost", "fault", "initial", "exit"],
    )


def _entered(table: pa.Table) -> pa.Table:
    """The state in which each part of a conversation is entered: each part's exit is the next one's entry."""
    table = table.sort_by([("block", "ascending"), ("entry", "ascending")])
    state, out, at = 0, [], []
    exits = {(b, e): x for b, e, x in zip(*(table.column(c).to_pylist() for c in ("block", "entry", "exit")), strict=True)}
    for k, block in enumerate(table.column("block").to_pylist()):
        if not at or block != table.column("block")[at[-1]].as_py():
            at.append(k)
            out.append(state)
            state = exits[block, state]
    kept = table.take(pa.array(at))
    return pa.table([kept.column("conv_id"), kept.column("block"), pa.array(out, pa.int8())], names=["conv_id", "block", "entered"])


def edits(placed: DataFrame, stage: common.Stage) -> DataFrame:
    """Every edit in order (conv_id, block, step): its initial (K, R, D, I), the row's place (null for an insert), the role
    it gives (null: the row's own), its cost, and the row's fault and initial. A table of the stage."""
    ident = placed.schema["conv_id"].dataType
    rows = stage.table("faults", faults(placed))
    parts = rows.groupBy("block").applyInArrow(_crossing, _ends_of(ident))
    parts = stage.table("parts", parts)
    counted = parts.groupBy("conv_id").agg(F.min("block").alias("from"), F.max("block").alias("to")).where(F.col("from") < F.col("to"))
    crossing = stage.table("crossing", parts.join(counted.select(F.col("conv_id").alias("id"), "from", "to").hint("merge"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id"))
    after = crossing.select("conv_id", "block", "costs").groupBy("conv_id").applyInArrow(_chained, _ends_of(ident)).select("block", "costs", F.lit(False).alias("begun"))
    before = crossing.where(F.col("block") > F.col("from")).select("block", F.lit(None).cast("array<long>").alias("costs"), F.lit(True).alias("begun"))
    known = stage.table("known", after.unionByName(before))
    solved = stage.table("solved", rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_solved, _edited(ident)))
    # Of a part that was traced from every state, the one trace whose entry is the exit of the part before stays.
    chain = crossing.select(F.col("conv_id").alias("id"), F.col("block").alias("at")).hint("merge")
    ends = solved.groupBy("conv_id", "block", "entry").agg(F.max("exit").alias("exit"))
    ends = ends.join(chain, ends["conv_id"].eqNullSafe(chain["id"]) & (ends["block"] == chain["at"])).drop("id", "at")
    enters = T.StructType([*_ends_of(ident).fields[:2], T.StructField("entered", T.ByteType())])
    entered = ends.groupBy("conv_id").applyInArrow(_entered, enters).withColumnsRenamed({"conv_id": "id", "block": "at"}).hint("merge")
    joined = solved.join(entered, (solved["block"] == entered["at"]) & solved["conv_id"].eqNullSafe(entered["id"]), "left")
    out = stage.table("edits", joined.where(F.col("entry") == F.coalesce("entered", F.lit(0))).drop("id", "at", "entered", "entry", "exit"))
    stage.drop("faults", "parts", "crossing", "known", "solved")
    return out


def repaired(placed: DataFrame, made: DataFrame) -> DataFrame:
    """The edits with each row's turn, the role it has now, and its text; an insert's text is empty, its turn null."""
    texts = placed.select("place", "turn", F.col("role").alias("own"), "text").hint("merge")
    return made.join(texts, "place", "left").withColumn("role", F.coalesce("role", "own")).withColumn("text", F.coalesce("text", F.lit(""))).drop("own")


AUDIT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its edits in order, which arrive a row at a time."""
    legal = {(0, 1), (1, 2), (2, 1)}
    held: dict | None = None

    def row(h: dict) -> pa.RecordBatch:
        turns = h["high"] - h["low"] + 1 - h["turns"] if h["turns"] else 0
        values = [turns, *h["faults"], h["illegal"], h["cost"]]
        return pa.RecordBatch.from_arrays([pa.array([h["id"]], h["type"]), *[pa.array([int(v)], pa.int64()) for v in values], pa.array(["".join(h["audit"])]), pa.array([h["sha"].hexdigest()])], ["conv_id", *AUDIT, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for ident, turn, edit, role, text, cost, fault, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "role", "text", "cost", "fault", "initial")), strict=True):
            if held is None or held["id"] != ident:
                if held is not None:
                    yield row(held)
                held = {"id": ident, "type": kind, "turns": 0, "low": None, "high": None, "faults": [0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "last": None, "first": True}
            held["cost"] += cost
            held["audit"].append(edit)
            if edit != "D":
                held["sha"].update((("" if held["first"] else "\n") + f"{role}:{text}").encode())
                held["first"] = False
            if edit != "I":
                if fault:
                    held["faults"][fault - 1] += 1
                if held["last"] is not None and (held["last"], initial) not in legal:
                    held["illegal"] += 1
                held["last"] = initial
                if turn is not None and turn != held["high"]:
                    held["turns"] += 1
                    held["low"], held["high"] = turn if held["low"] is None else held["low"], turn
    if held is not None:
        yield row(held)


def audits(told: DataFrame, ids: DataFrame, stage: common.Stage) -> DataFrame:
    """One row for each of ``ids``: gaps in the turns, faults, illegal neighbours, cost, the edits' initials, and the SHA-256 of
    the repaired ``role:text`` lines. Ids without rows have zeros and hashes of nothing."""
    kind = told.schema["conv_id"].dataType.simpleString()
    rows = told.select("conv_id", "turn", "edit", "role", "text", "cost", "fault", "initial", "block", "step").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block", "step")
    done = common.mapped(rows, _audit, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in AUDIT) + ", audit string, repaired_sha256 string")
    with common.settings(told.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": common.BATCH_BYTES}):
        done = stage.table("audits", done).withColumnRenamed("conv_id", "id").hint("merge")
    joined = ids.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select("conv_id", *[zero(c) for c in AUDIT], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, stage: common.Stage) -> DataFrame:
    """``repaired`` rows of (conv_id, turn, role, text); those whose edit isn't D are the conversations as mended."""
    placed = ordered(rows, stage)
    return repaired(placed, edits(placed, stage))
