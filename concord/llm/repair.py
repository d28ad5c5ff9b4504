"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A run-length dynamic programme. Rows become symbols of role and fault; equal neighbours are one run. What a row
can do to a conversation is a 4 by 4 matrix of costs (from each state to each), matrices are combined by adding
and taking the least (min-plus), and a run is passed by the binary powers of its matrix, which are kept. As
matrices of pieces combine to the matrix of the whole, a conversation is cut into segments that are worked on in
different tasks; only what must be in order passes through one task, and that as a stream of segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.registry import query, small_batches, table
from concord.session import materialise

#: What each edit costs; an undeleted truncated row adds one.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row. Ends are 0 and 3.
START, SYSTEM, USER, ASSISTANT = range(4)
_ALTERNATE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Symbols: a row that must go, then each class of role, whole and cut off.
GONE, ROLES = 0, "sua?"
NEVER = 1 << 40
#: Rows and characters of a segment that end it.
SEGMENT_ROWS, SEGMENT_CHARS = 2048, 1 << 20

Vector = tuple[int, ...]


def initial(role: str) -> str:
    """The initial of a role if it is one that a conversation may keep."""
    return role[:1] if role[:1] and role[:1] in "sua" else "?"


def symbol(role: str, cut_off: bool) -> int:
    """The symbol of a row that may stay."""
    return 1 + 2 * ROLES.index(initial(role)) + cut_off


# The programme


@lru_cache(maxsize=None)
def row_matrix(sym: int) -> np.ndarray:
    """Least cost from state to state over one row, with any inserts before it."""
    insert = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(insert, 0)
    for start in range(4):
        state, cost = start, 0
        for _ in range(3):
            state, cost = _ALTERNATE[state], cost + INSERT
            insert[start, state] = min(insert[start, state], cost)
    own = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        for _, cost, to in _choices(sym, state):
            own[state, to] = min(own[state, to], cost)
    return times(insert, own)


def _choices(sym: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state, in ASCII order: initial, cost, next state."""
    out = [("D", DELETE, state)]
    if sym != GONE:
        role, late = ROLES[(sym - 1) // 2], CUT_OFF * ((sym - 1) % 2)
        if (state, role) in _KEPT:
            out.append(("K", KEEP + late, _KEPT[state, role]))
        out.append(("R", REROLE + late, _ALTERNATE[state]))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> np.ndarray:
    """The matrix of 2**k rows of one symbol."""
    return row_matrix(sym) if k == 0 else times(power(sym, k - 1), power(sym, k - 1))


def run_matrix(sym: int, n: int) -> np.ndarray:
    out, k = None, 0
    while n:
        if n & 1:
            out = power(sym, k) if out is None else times(out, power(sym, k))
        n, k = n >> 1, k + 1
    return out


_run_matrix = lru_cache(maxsize=4096)(run_matrix)


def segment_matrix(runs: list[tuple[int, int]]) -> np.ndarray:
    out = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(out, 0)
    for sym, n in runs:
        out = times(out, _run_matrix(sym, n))
    return out


#: What each state still costs once no row is left: inserts alone.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def before(matrix: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (matrix + after[None]).min(1)


def relative(costs: np.ndarray) -> Vector:
    """Only differences decide, so what choices depend on has few forms."""
    return tuple(int(x) for x in costs - costs.min())


@lru_cache(maxsize=65536)
def _one_before(sym: int, after: Vector) -> Vector:
    return relative(before(row_matrix(sym), np.array(after)))


@lru_cache(maxsize=65536)
def _step(sym: int, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits at one row, inserts before it included, and the next state.

    ``after`` is what each state costs behind the row. A row is left as soon as no insert is both cheapest and less
    than the edit of the row itself; an edit's initial and the state give the next state, so taking the least initial
    each time gives the least audit.
    """
    here, edits = before(row_matrix(sym), np.array(after)), []
    while True:
        ways = [(e, to) for e, cost, to in _choices(sym, state) if cost + after[to] == here[state]]
        more = _ALTERNATE[state]
        if INSERT + here[more] == here[state] and (not ways or ways[0][0] > "I"):
            edits.append("I")
            state = more
            continue
        edits.append(ways[0][0])
        return "".join(edits), ways[0][1]


def unroll(runs: list[tuple[int, int]], after: Vector, state: int) -> tuple[str, int]:
    """The edits of a segment from a state, given what each state costs behind it; and the state it ends in."""
    ends = [after]
    for sym, n in reversed(runs[1:]):
        ends.append(relative(before(_run_matrix(sym, n), np.array(ends[-1]))))
    out = []
    for (sym, n), end in zip(runs, reversed(ends)):
        if sym == GONE:  # deleting first is cheapest and ASCII-least in every state
            out.append("D" * n)
            continue
        behind = [end]
        for _ in range(n - 1):
            behind.append(_one_before(sym, behind[-1]))
        for costs in reversed(behind):
            edits, state = _step(sym, costs, state)
            out.append(edits)
    return "".join(out), state


def last_inserts(state: int) -> str:
    return "I" * (END[state] // INSERT)


# Rows on Spark


def _key(c: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies``: the rows after damage by crc32 of ``conv_id:turn`` modulo 20."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    return turns.select(
        _key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(some("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    ).filter("copies > 0")


def faults(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, n, blank, first, cut_off``: equal rows of a turn as one row with their number.

    ``first`` says that the first of the ``n`` is the first with its role and text in the conversation. Equal rows meet
    by combined counts and first turns by combined minima, so a row that repeats in a third of the table is no group.
    """
    same = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    same = same.withColumn("has", F.col("turn").isNotNull()).withColumn("digest", F.sha2("text", 256))
    same = materialise(same, "equal-turns")
    firsts = same.groupBy("conv", "role", "digest").agg(F.min(F.struct("has", "turn")).alias("least"))
    both = same.join(firsts, ["conv", "role", "digest"])
    return both.select(
        "conv", "has", "turn", "role", "text", "n",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.struct("has", "turn").eqNullSafe(F.col("least")).alias("first"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"),
    )


def _totals(rows: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation."""
    stays = F.when(F.col("first"), 1).otherwise(0)
    n = lambda when, value: F.sum(F.when(when, value).otherwise(0))
    by_turn = rows.groupBy("conv", "turn").agg(
        n(F.col("blank"), F.col("n")).alias("blank"), n(~F.col("blank"), F.col("n") - stays).alias("duplicate"), n(~F.col("blank") & F.col("cut_off"), stays).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


_SEGMENT = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("matrix", pa.list_(pa.int64())), ("syms", pa.list_(pa.int64())),
                      ("counts", pa.list_(pa.int64())), ("initials", pa.string()), ("illegal", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_SEGMENT_SQL = "conv string, part long, seg long, matrix array<long>, syms array<long>, counts array<long>, initials string, illegal long, roles array<string>, texts array<string>"
LEGAL = ("su", "ua", "au")


class _Segment:
    def __init__(self) -> None:
        self.runs: list[list[int]] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.first, self.last, self.illegal, self.size = "", "", 0, 0

    def add(self, role: str, text: str, n: int, blank: bool, first: bool, cut_off: bool) -> None:
        if self.first:
            self.illegal += self.last + initial(role) not in LEGAL
        else:
            self.first = initial(role)
        self.last = initial(role)
        self.illegal += n - 1
        if first and not blank:
            self._run(symbol(role, cut_off), 1)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text)
            n -= 1
        if n:
            self._run(GONE, n)

    def _run(self, sym: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == sym:
            self.runs[-1][1] += n
        else:
            self.runs.append([sym, n])

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or len(self.runs) >= SEGMENT_ROWS or self.size >= SEGMENT_CHARS

    def row(self, conv: str, part: int, seg: int) -> dict:
        matrix = segment_matrix([tuple(r) for r in self.runs])
        return {"conv": conv, "part": part, "seg": seg, "matrix": matrix.ravel().tolist(), "syms": [s for s, _ in self.runs], "counts": [n for _, n in self.runs], "initials": self.first + self.last,
                "illegal": self.illegal, "roles": self.roles, "texts": self.texts}


def _segments(rows: DataFrame) -> DataFrame:
    """Rows in order, cut into segments; a long conversation lies in several ranges and so in several tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, conv, now, done, held = TaskContext.get().partitionId(), 0, None, _Segment(), [], 0
        for batch in batches:
            for c, role, text, n, blank, first, cut_off in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text", "n", "blank", "first", "cut_off"))):
                if now.runs and (c != conv or now.full()):
                    done.append(now.row(conv, part, number))
                    held += 1000 + now.size
                    number, now = number + 1, _Segment()
                conv = c
                now.add(role, text, n, blank, first, cut_off)
                if held > 1 << 21:
                    yield pa.RecordBatch.from_pylist(done, _SEGMENT)
                    done, held = [], 0
        if now.runs:
            done.append(now.row(conv, part, number))
        if done:
            yield pa.RecordBatch.from_pylist(done, _SEGMENT)

    order = [F.col("conv"), F.col("has"), F.col("turn"), F.col("role")]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return ranged.select("conv", "role", "text", "n", "blank", "first", "cut_off").mapInArrow(task, _SEGMENT_SQL)


def _lasting(segments: DataFrame) -> DataFrame:
    """``conv, part, seg, after, cost``: what each state costs behind a segment, and state 0 from it on.

    Segments of a conversation pass one task last to first, sixteen numbers each.
    """
    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("after", pa.list_(pa.int64())), ("cost", pa.int64())])

    def task(batches):
        conv, costs = None, np.array(END)
        for batch in batches:
            out = []
            for c, part, seg, matrix in zip(*(batch.column(x).to_pylist() for x in ("conv", "part", "seg", "matrix"))):
                if c != conv:
                    conv, costs = c, np.array(END)
                after, costs = costs, before(np.array(matrix).reshape(4, 4), costs)
                out.append({"conv": c, "part": part, "seg": seg, "after": list(relative(after)), "cost": int(costs[START])})
            yield pa.RecordBatch.from_pylist(out, schema)

    own = segments.select("conv", "part", "seg", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seg"))
    return own.mapInArrow(task, "conv string, part long, seg long, after array<long>, cost long")


def _unrolled(segments: DataFrame, lasting: DataFrame) -> DataFrame:
    """``conv, part, seg, cost, audits, exits``: the edits of each segment from each of the four states."""
    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("cost", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])

    def task(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ways = [unroll(list(zip(row["syms"], row["counts"])), tuple(row["after"]), state) for state in range(4)]
                out.append({k: row[k] for k in ("conv", "part", "seg", "cost")} | {"audits": [a for a, _ in ways], "exits": [s for _, s in ways]})
            yield pa.RecordBatch.from_pylist(out, schema)

    own = segments.select("conv", "part", "seg", "syms", "counts").join(lasting, ["conv", "part", "seg"])
    return own.mapInArrow(task, "conv string, part long, seg long, cost long, audits array<string>, exits array<long>")


def _rows_after(edits: str, runs: Iterator[tuple[int, int]], roles: list[str], texts: list[str], state: int) -> Iterator[str]:
    """The rows that the edits leave, as ``role:text``."""
    at, gone, symbols = 0, 0, iter(runs)
    sym, left = next(symbols, (GONE, 0))
    for e in edits:
        if e == "I":
            state = _ALTERNATE[state]
            yield ("user:", "assistant:")[state == ASSISTANT]
            continue
        while not left:
            sym, left = next(symbols)
        left -= 1
        if sym != GONE:
            role, text = roles[at], texts[at]
            at += 1
            if e == "K":
                state = _KEPT[state, role[:1]]
                yield f"{role}:{text}"
            elif e == "R":
                state = _ALTERNATE[state]
                yield f"{('user', 'assistant')[state == ASSISTANT]}:{text}"


def _finished(segments: DataFrame, unrolled: DataFrame) -> DataFrame:
    """``conv, illegal, cost, audit, repaired_sha256``: segments of a conversation in order, as a stream.

    A SHA-256 of a whole conversation can only be taken in order, so its text passes one task, a segment at a time.
    """
    schema = pa.schema([("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def task(batches):
        conv, out = None, []

        def row():
            closing = last_inserts(state)
            for text in _rows_after(closing, iter(()), [], [], state):
                digest.update(("\n" * started[0] + text).encode())
                started[0] = True
            return {"conv": conv, "illegal": illegal, "cost": cost, "audit": "".join(audit) + closing, "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for r in batch.to_pylist():
                first, last = r["initials"]
                if r["conv"] != conv:
                    if conv is not None:
                        out.append(row())
                    conv, illegal, cost, audit, digest, started, state = r["conv"], 0, r["cost"], [], hashlib.sha256(), [False], START
                else:
                    illegal += ending + first not in LEGAL
                illegal += r["illegal"]
                ending = last
                edits = r["audits"][state]
                for text in _rows_after(edits, zip(r["syms"], r["counts"]), r["roles"], r["texts"], state):
                    digest.update(("\n" * started[0] + text).encode())
                    started[0] = True
                audit.append(edits)
                state = r["exits"][state]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if conv is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    own = segments.drop("matrix").join(unrolled, ["conv", "part", "seg"]).repartition("conv").sortWithinPartitions("conv", "part", "seg")
    return own.mapInArrow(task, "conv string, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation.

    A null role or text is one space, a null turn comes first, and rows without a conversation id are one
    conversation, with a null id. Rows of one turn are in the order of role and text. Other columns than
    ``conv_id, turn, role, text`` are not looked at.
    """
    with small_batches(turns.sparkSession, 64):
        rows = materialise(faults(damaged(turns)), "faults")
        segments = materialise(_segments(rows), "segments")
        unrolled = materialise(_unrolled(segments, _lasting(segments)), "unrolled")
        ends = materialise(_finished(segments, unrolled), "repaired")
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("rows")).select("conv_id", _key("conv_id").alias("conv"))
    both = ids.join(_totals(rows), "conv", "left").join(ends, "conv", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select("conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
