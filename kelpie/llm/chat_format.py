"""Minimum-cost repair of conversation roles by dynamic programming over an automaton of legal turns.

Legal is: an optional system turn first, then user and assistant in turn, the user first. A turn may keep its role,
take another (RELABEL), be merged into the turn before it (MERGE), or have an empty turn put before it (INSERT). The
repair with the least total cost is found, and rendered.

The program's state is the role of the last turn made, so a stretch of turns is a small matrix of least costs from
state to state, and such matrices compose. Conversations up to BLOCK turns are one stretch. Longer ones, which may
hold a large part of all rows, are dealt out in order by range and cut into blocks. Their matrices meet and give each
block the least costs at its entry; with these a block makes the same choices as one pass over the whole conversation
would, so rows don't depend on the blocks. What each exit state leads back to meets once more, and then each block is
repaired from its exit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.llm.common import Scratch, in_slices, prepare

MERGE, INSERT, RELABEL = 1, 2, 3
BLOCK = 4096
#: The role of a state from 1 on; state 0 is that of no turn yet.
ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
NEXT = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2}}
FAR = 1 << 40
#: Least costs by state before the first turn.
ENTRY = (0, FAR, FAR, FAR)


def canonical(role: str | None) -> int:
    """A role's state, or 0 for one that isn't known."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) + 1 if r in ROLES else 0


def _moves() -> dict[int, list[tuple[int, int, int, str, int]]]:
    """By role: (from, to, cost, what is done, the empty turn put before), those to prefer at equal cost first."""
    out: dict[int, list] = {}
    for role in range(4):
        own = []
        for s in range(4):
            for q in (1, 2, 3):
                base = 0 if q == role else RELABEL
                if q == s:
                    own.append((s, q, base + MERGE, "merge", 0))
                elif q in NEXT[s]:
                    own.append((s, q, base, "keep" if q == role else "relabel", 0))
                else:
                    own += [(s, q, base + INSERT, "keep" if q == role else "relabel", m) for m in sorted(NEXT[s]) if q in NEXT[m]]
        out[role] = sorted(own, key=lambda x: x[2])
    return out


MOVES = _moves()


def matrix(roles: list[int]) -> np.ndarray:
    """Least costs from each state to each, over a stretch."""
    m = np.full((4, 4), FAR)
    np.fill_diagonal(m, 0)
    for r in roles:
        n = np.full((4, 4), FAR)
        for s, q, c, _, _ in MOVES[r]:
            n[:, q] = np.minimum(n[:, q], m[:, s] + c)
        m = n
    return m


def repair(roles: list[int], entry: tuple[int, ...] = ENTRY, ends: tuple[int, ...] = (2, 3)) -> list[tuple[int, int, int, str, int]]:
    """The moves of a cheapest repair from a state, by least costs at entry, to one of the ends; the earlier of equally cheap moves."""
    cost = list(entry)
    back = []
    for r in roles:
        new, how = [FAR] * 4, [None] * 4
        for move in MOVES[r]:
            c = cost[move[0]] + move[2]
            if c < new[move[1]]:
                new[move[1]], how[move[1]] = c, move
        cost = new
        back.append(how)
    if not roles:
        return []
    at = min(ends, key=lambda s: (cost[s], s))
    out = []
    for how in reversed(back):
        out.append(how[at])
        at = how[at][0]
    return out[::-1]


def origins(roles: list[int], entry: tuple[int, ...]) -> list[int]:
    """For each exit state, the state at the entry that repair() to it begins from; -1 where it can't be reached."""
    cost, origin = list(entry), list(range(4))
    for r in roles:
        new, old = [FAR] * 4, [-1] * 4
        for s, q, c, _, _ in MOVES[r]:
            if cost[s] + c < new[q]:
                new[q], old[q] = cost[s] + c, origin[s]
        cost, origin = new, old
    return origin


def _ranked(block: int):
    """Numbers sorted rows within their task, and the blocks they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            at = np.arange(seq, seq + b.num_rows)
            seq += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((np.int64(part) << 32) + at // block), pa.array(at)], names=[*b.schema.names, "block", "seq"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (conv_id, block) runs of sorted rows; a run has BLOCK rows at most."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        key = list(zip(rest.column("conv_id").to_pylist(), rest.column("block").to_pylist(), strict=True))
        cut = len(key)
        while cut and key[cut - 1] == key[-1]:
            cut -= 1
        if cut:
            yield from _cut(rest.slice(0, cut), key[:cut])
            rest = rest.slice(cut)
    if rest is not None:
        yield from _cut(rest, list(zip(rest.column("conv_id").to_pylist(), rest.column("block").to_pylist(), strict=True)))


def _cut(t: pa.Table, key: list) -> Iterator[pa.Table]:
    start = 0
    for i in range(1, len(key) + 1):
        if i == len(key) or key[i] != key[start]:
            yield t.slice(start, i - start)
            start = i


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches):
        m = matrix([canonical(r) for r in t.column("role").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([t.column("conv_id")[0].as_py()], pa.int64()), pa.array([t.column("block")[0].as_py()], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))], names=["conv_id", "block", "m"])


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches):
        x = origins([canonical(r) for r in t.column("role").to_pylist()], t.column("entry")[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([t.column(c)[0].as_py()], pa.int64()) for c in ("conv_id", "block")] + [pa.array([x], pa.list_(pa.int32()))], names=["conv_id", "block", "origins"])


def _entered(rows: pd.DataFrame) -> pd.DataFrame:
    """The least costs at the entry of each of a conversation's blocks, and after the last one the best state to end in."""
    rows = rows.sort_values("block")
    cost, entries = np.array(ENTRY), []
    for m in rows["m"]:
        entries.append(cost.tolist())
        cost = np.minimum((cost[:, None] + np.array(m).reshape(4, 4)).min(0), FAR)
    at = min((2, 3), key=lambda s: (cost[s], s))
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "entry": entries, "end": at})


def _left(rows: pd.DataFrame) -> pd.DataFrame:
    """The exit state of each of a conversation's blocks, from the last one back."""
    rows = rows.sort_values("block")
    at, exits = int(rows["end"].iloc[-1]), []
    for x in reversed(rows["origins"].tolist()):
        exits.append(at)
        at = int(x[at])
    return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "entry": rows["entry"], "exit": exits[::-1], "last": [False] * (len(rows) - 1) + [True]})


OUT = "conv_id long, turn long, role string, action string, role_out string, inserted string, cost int, out_turn long, rendered string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in OUT.split(", ")] + ["block"]
    cols: list[list] = [[] for _ in kinds]
    for t in _runs(batches):
        rows = t.to_pylist()
        entry, exit_ = rows[0]["entry"], rows[0]["exit"]
        moves = repair([canonical(r["role"]) for r in rows], entry or ENTRY, (exit_,) if exit_ is not None else (2, 3))
        n = -1
        for r, (s, q, cost, what, empty) in zip(rows, moves, strict=True):
            text = r["text"] or ""
            if what == "merge":
                out = "\n" + text
            else:
                n += 2 if empty else 1
                out = ("<|end|>\n" if s else "") + (f"<|{ROLES[empty - 1]}|>\n<|end|>\n" if empty else "") + f"<|{ROLES[q - 1]}|>\n" + text
            if r is rows[-1] and r["last"]:
                out += "<|end|>\n"
            for c, v in zip(cols, (r["conv_id"], r["turn"], r["role"], what, ROLES[q - 1], ROLES[empty - 1] if empty else None, cost, n, out, r["block"]), strict=True):
                c.append(v)
        if len(cols[0]) >= BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            cols = [[] for _ in kinds]
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def repaired_turns(spark: SparkSession, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (OUT), one for each row of turns (conv_id, turn, role, text).

    action: keep, relabel or merge. inserted: the role of an empty turn put before. out_turn: its place among the turns
    made, from 0. rendered: what the row adds to the conversation's text; joined in the order of out_turn and turn they
    are all of it. Turns are ordered by turn (null first), role and text. Null and unknown roles are relabelled, a null
    text is empty, rows with a null conv_id are one conversation. Repeated rows are turns of their own; other columns are
    ignored. block: turns in a block, which the rows don't depend on. Texts are rendered as they are: a text that holds
    the marks <|end|> or <|user|> itself can't be told from turns; who needs that has to escape them before.
    """
    prepare(spark)
    scratch = Scratch(spark, "chat")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    long_ = turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    order = ["conv_id", "turn", "role", "text"]
    short = turns.join(long_, same, "left_anti").withColumn("block", F.lit(0).cast("long")).withColumn("seq", F.lit(0).cast("long"))
    dealt = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq", *order[1:])
    whole = short.withColumn("entry", F.lit(None).cast("array<long>")).withColumn("exit", F.lit(None).cast("int")).withColumn("last", F.lit(True))
    schema = f"{OUT}, block long"
    out = dealt(whole).transform(in_slices, _repaired, schema)
    if not long_.isEmpty():
        many = turns.join(long_, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
        many = scratch.save(many.transform(in_slices, _ranked(block), "conv_id long, turn long, role string, text string, block long, seq long"), "blocks")
        keys = "conv_id long, block long"
        renamed = lambda df: df.withColumnRenamed("conv_id", "c").withColumnRenamed("block", "b")
        at = same & (F.col("block") == F.col("b"))
        entered = dealt(many).transform(in_slices, _matrices, f"{keys}, m array<long>").groupBy("conv_id").applyInPandas(_entered, f"{keys}, entry array<long>, end int")
        entered = scratch.save(entered, "entered")
        led = dealt(many.join(renamed(entered), at).drop("c", "b")).transform(in_slices, _origins, f"{keys}, origins array<int>")
        states = led.join(renamed(entered), at).drop("c", "b").groupBy("conv_id").applyInPandas(_left, f"{keys}, entry array<long>, exit int, last boolean")
        states = renamed(scratch.save(states, "states"))
        many = many.join(states, at).select("conv_id", "turn", "role", "text", "block", "seq", "entry", "exit", "last")
        done = scratch.save(dealt(many).transform(in_slices, _repaired, schema), "done")
        made = done.groupBy("conv_id", "block").agg((F.max("out_turn") + 1).alias("made"))
        before = F.coalesce(F.sum("made").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        made = made.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), before.alias("before"))
        out = out.unionByName(done.join(made, at).withColumn("out_turn", F.col("out_turn") + F.col("before")).drop("c", "b", "before"))
    return out.drop("block")
