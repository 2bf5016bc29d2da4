"""Chat formatting with minimum-cost role repair.

A conversation must walk a legal-turn automaton: an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over its states chooses for each turn to keep it, relabel it, merge it into the message
before, or to insert empty messages first; the cheapest walk is rendered.

Turns are dealt by ranges of (conversation, turn), so a conversation with very many turns is spread over tasks. A turn
acts on the costs of the states as a matrix in the (min, +) semiring; the matrices of a chunk multiply to one. Chunks of a
conversation, then of its ranges, are combined from those products alone, which fixes the states at both ends of every
chunk; each chunk is then repaired alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: States: before any message, or the role of the last message.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ROLES = {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
#: Legal next messages of each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, INSERT, UNKNOWN = 3, 1, 2, 1
FAR = 1 << 40
CHUNK_TURNS = 256
CHUNK_CHARS = 1 << 20


def _insertions() -> list[list[list[int] | None]]:
    """Shortest lists of inserted roles from state to state."""
    out: list[list[list[int] | None]] = [[None] * STATES for _ in range(STATES)]
    for s in range(STATES):
        out[s][s] = []
        todo = [s]
        while todo:
            at = todo.pop(0)
            for t in LEGAL[at]:
                if out[s][t] is None:
                    out[s][t] = [*out[s][at], t]
                    todo.append(t)
    return out


PATHS = _insertions()


def _steps(role: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """step[s][t]: (cost, action, inserted roles) of the cheapest way for a turn of ``role`` (0: unknown) from state s to t."""
    change = [0 if r == role else (UNKNOWN if role == 0 else RELABEL) for r in range(STATES)]
    table = []
    for s in range(STATES):
        row = []
        for t in range(STATES):
            options = [(FAR, "", ())]
            if t == s != START:
                options.append((MERGE + change[t], "merge", ()))
            for mid in range(STATES):
                if t in LEGAL[mid] and PATHS[s][mid] is not None:
                    options.append((INSERT * len(PATHS[s][mid]) + change[t], "keep" if change[t] == 0 else "relabel", tuple(PATHS[s][mid])))
            row.append(min(options))
        table.append(row)
    return table


STEP = [_steps(r) for r in range(STATES)]
COST = np.array([[[STEP[r][s][t][0] for t in range(STATES)] for s in range(STATES)] for r in range(STATES)], dtype=np.int64)
FINISH = [FAR if PATHS[s][ASSISTANT] is None else INSERT * len(PATHS[s][ASSISTANT]) for s in range(STATES)]
FINISH[START] = 0  # an empty conversation stays empty


def role_of(name: str | None) -> int:
    return ROLES.get((name or "").strip().lower(), 0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def transfer(roles: list[int]) -> np.ndarray:
    """Cheapest costs from state to state over turns of these roles."""
    out = np.full((STATES, STATES), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for r in roles:
        out = product(out, COST[r])
    return out


def through(matrices: list[np.ndarray], start: int, finish: list[int]) -> list[int]:
    """The states after each matrix on a cheapest walk from ``start``, where ``finish`` are the costs of ending in each state."""
    after = [np.array(finish, dtype=np.int64)]
    for m in reversed(matrices):
        after.append((m + after[-1][None, :]).min(axis=1))
    after.reverse()
    out, s = [], start
    for m, rest in zip(matrices, after[1:], strict=True):
        s = int(np.argmin(m[s] + rest))
        out.append(s)
    return out


def repair(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, inserted roles before it) of each turn on a cheapest walk from ``start``; ``end`` fixes the last state."""
    finish = FINISH if end is None else [0 if s == end else FAR for s in range(STATES)]
    states = through([COST[r] for r in roles], start, finish)
    return [(t, *STEP[r][s][t][1:]) for r, s, t in zip(roles, [start, *states[:-1]][: len(states)], states, strict=True)]


def header(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


CLOSE = "<|end|>\n"

_CHUNK = "conv {id}, part int, chunk int, turns array<struct<turn:{turn},role:string,text:string>>, trans array<long>"
_KEYS = ["conv", "part", "chunk"]
#: Chunks, and turns of rendered chunks, that a task passes on at once.
_AT_ONCE = 2000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, turn, role, text, part) of a partition to chunks of one conversation each, in order.

    Values stay Arrow's and Python's own, so whole numbers of any size pass beside nulls.
    """
    held: list[dict] = []
    done: list[dict] = []
    schema, size, number = None, 0, 0

    def close() -> None:
        nonlocal held, size, number
        if held:
            trans = transfer([role_of(t["role"]) for t in held])
            done.append({"conv": held[0]["conv"], "part": held[0]["part"], "chunk": number, "turns": [{k: t[k] for k in ("turn", "role", "text")} for t in held], "trans": trans.ravel().tolist()})
            number += 1
        held, size = [], 0

    def out() -> pa.RecordBatch:
        ready = pa.RecordBatch.from_pylist(done, schema=schema)
        done.clear()
        return ready

    for batch in batches:
        if schema is None:
            own = pa.struct([pa.field(k, batch.schema.field(k).type) for k in ("turn", "role", "text")])
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("chunk", pa.int32()), ("turns", pa.list_(own)), ("trans", pa.list_(pa.int64()))])
        for row in batch.to_pylist():
            if held and (held[0]["conv"] != row["conv"] or len(held) >= CHUNK_TURNS or size >= CHUNK_CHARS):
                close()
            held.append(row)
            size += len(row["text"] or "")
            if len(done) >= _AT_ONCE:
                yield out()
    close()
    if done:
        yield out()


def _ends(summary: DataFrame, id_type: str) -> DataFrame:
    """(conv, part, chunk, first, last): the states at both ends of each chunk of conversations that have several.

    Products are combined in two levels: chunks of one range, then ranges of one conversation. A group is at most the
    chunks of one partition, or one row for each partition.
    """
    many = summary.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"))
    own = staged(summary.join(many, F.col("conv").eqNullSafe(F.col("c")), "left_semi"), "chat-many")

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for trans in rows.sort_values("chunk")["trans"]:
            m = np.array(trans).reshape(STATES, STATES)
            out = m if out is None else product(out, m)
        return pd.DataFrame([{"conv": key[0], "part": key[1], "trans": out.ravel().tolist()}])

    def places(column: str):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(column)
            start = int(rows["first"].iloc[0]) if "first" in rows else START
            finish = [0 if s == rows["last"].iloc[0] else FAR for s in range(STATES)] if "last" in rows else FINISH
            states = through([np.array(t).reshape(STATES, STATES) for t in rows["trans"]], start, finish)
            rows = rows.assign(first=[start, *states[:-1]], last=states)
            return rows[["conv", "part", *(["chunk"] if column == "chunk" else []), "first", "last"]]

        return run

    ranges = own.groupBy("conv", "part").applyInPandas(whole, f"conv {id_type}, part int, trans array<long>")
    ends = staged(ranges.groupBy("conv").applyInPandas(places("part"), f"conv {id_type}, part int, first int, last int"), "chat-ranges")
    e = ends.select(F.col("conv").alias("c"), F.col("part").alias("p"), "first", "last")
    inner = own.join(e, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv", "part", "chunk", "trans", "first", "last")
    return inner.groupBy("conv", "part").applyInPandas(places("chunk"), f"conv {id_type}, part int, chunk int, first int, last int")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, chunk, pos, turn, role, repaired_role, action, inserted, segment): every turn, repaired and rendered.

    The segments of a conversation in the order (part, chunk, pos) join to its rendered text: a header opens a message, a
    merged turn continues it on a new line, empty messages are inserted whole, and the last turn closes the conversation.
    Turns are ordered by turn number (nulls first), then role and text; equal rows stay, each as a turn. Rows of a null
    conversation form one conversation. Null or unknown roles may take any role at a small cost; null texts are empty.
    """
    id_type, turn_type = turns.schema[conv_col].dataType.simpleString(), turns.schema[turn_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").withColumn("part", F.spark_partition_id())
    chunks = staged(dealt.mapInArrow(_chunks, _CHUNK.format(id=id_type, turn=turn_type)), "chat-chunks")
    ends = staged(_ends(chunks.select(*_KEYS, "trans"), id_type), "chat-ends").select(*[F.col(k).alias(f"end_{k}") for k in _KEYS], "first", "last")
    last = staged(chunks.groupBy("conv").agg(F.max(F.struct("part", "chunk")).alias("tail")).select("conv", "tail.part", "tail.chunk"), "chat-tails").select(*[F.col(k).alias(f"tail_{k}") for k in _KEYS])
    placed = chunks.drop("trans").join(ends, F.col("conv").eqNullSafe(F.col("end_conv")) & (F.col("part") == F.col("end_part")) & (F.col("chunk") == F.col("end_chunk")), "left")
    placed = placed.join(last, F.col("conv").eqNullSafe(F.col("tail_conv")) & (F.col("part") == F.col("tail_part")) & (F.col("chunk") == F.col("tail_chunk")), "left")
    placed = placed.select(*_KEYS, "turns", "first", "last", F.col("tail_part").isNotNull().alias("closes"))
    out = f"conv {id_type}, part int, chunk int, pos int, turn {turn_type}, role string, repaired_role string, action string, inserted int, segment string"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("conv").type, pa.int32(), pa.int32(), pa.int32(), batch.schema.field("turns").type.value_type.field("turn").type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            names = ["conv", "part", "chunk", "pos", "turn", "role", "repaired_role", "action", "inserted", "segment"]
            done: list[tuple] = []

            def ready(done=done, kinds=kinds, names=names) -> pa.RecordBatch:
                columns = zip(*done, strict=True) if done else [()] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

            for row in batch.to_pylist():
                own, first, end = row["turns"], row["first"], row["last"]
                start = START if first is None else first
                fixed = repair([role_of(t["role"]) for t in own], start, end)
                state = start
                for pos, (t, (role, action, inserted)) in enumerate(zip(own, fixed, strict=True)):
                    text = t["text"] or ""
                    if action == "merge":
                        segment = "\n" + text
                    else:
                        segment = (CLOSE if state != START else "") + "".join(header(r) + CLOSE for r in inserted) + header(role) + text
                    state = role
                    if row["closes"] and pos == len(own) - 1:
                        segment += CLOSE + "".join(header(r) + CLOSE for r in PATHS[role][ASSISTANT])
                    done.append((row["conv"], row["part"], row["chunk"], pos, t["turn"], t["role"], NAMES[role], action, len(inserted), segment))
                if len(done) >= _AT_ONCE:
                    yield ready()
                    done.clear()
            yield ready()

    return placed.mapInArrow(render, out)
