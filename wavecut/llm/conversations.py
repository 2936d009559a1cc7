"""Cheapest repair of the turn structure of conversations.

A repaired conversation has the role initials ``(s?(ua)+)?``, which a machine of four states reads: nothing yet,
after a system turn, after a user, after an assistant.  Every turn is kept, given another role or deleted, and turns
without text may be inserted anywhere; the cheapest edits win, of equally cheap ones those whose initials (Delete,
Insert, Keep, Rerole) come first in ASCII.

Divide and conquer: the cost vector over the four states runs forward to the middle and backward from the end, and
the state in which both meet at least cost is fixed; both halves are solved alone, in linear space.  Of several
states the forward run knows which has the least edits so far: the edits that end in two states never begin one
another, as both consume the same turns, so ranks of the states stand for the strings.

Conversations are ordered by a range partitioning and cut into chunks of bounded size.  A chunk is summarised by its
four vectors, the crossing states at the borders of chunks are found on the summaries alone, and each chunk is
repaired in a task of its own, so that a conversation of any length spreads over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written

STATES = range(4)
INF = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: State after a user or assistant turn that fits, the role that fits, and the cost of closing a conversation.
NEXT, FITS, CLOSE = (2, 2, 3, 2), "uuau", (0, 2 * INSERT, INSERT, 0)
CLOSING = ("", "II", "I", "")
SPACES = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}

#: ``cost[p][t]`` of the cheapest way from state p to t, and ``order[p][t]``: the rank of its edits among those from p.
Step = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]


@lru_cache(maxsize=64)
def turn_step(code: str) -> tuple[Step, tuple[tuple[str, ...], ...]]:
    """Step over one turn, and its edits.

    ``code``: ``D`` for a turn that must go, else ``s``, ``u``, ``a`` or ``x`` (another role), in capitals if truncated.
    """
    cost = [[INF] * 4 for _ in STATES]
    edits = [[""] * 4 for _ in STATES]
    role, extra = code.lower(), TRUNCATED if code.isupper() else 0
    for p in STATES:
        at = p
        for inserts in range(3):
            options = [("D", at, DELETE)]
            if code != "D":
                options.append(("R", NEXT[at], REROLE + extra))
                if role == FITS[at]:
                    options.append(("K", NEXT[at], extra))
                if role == "s" and at == 0:
                    options.append(("K", 1, extra))
            for op, t, c in options:
                found = (c + INSERT * inserts, "I" * inserts + op)
                if found < (cost[p][t], edits[p][t]):
                    cost[p][t], edits[p][t] = found
            at = NEXT[at]
    order = tuple(tuple(sorted(row).index(e) for e in row) for row in edits)
    return (tuple(map(tuple, cost)), order), tuple(map(tuple, edits))


def forward(steps: Sequence[Step], cost: Sequence[int], rank: Sequence[int]) -> tuple[list[int], list[int]]:
    """Least cost of every state after the steps, and the ranks of the least edits that reach it."""
    cost, rank = list(cost), list(rank)
    for c, order in steps:
        best = []
        for t in STATES:
            best.append(min((cost[p] + c[p][t], rank[p], order[p][t]) for p in STATES))
        ranked = sorted(b[1:] for b in best)
        cost, rank = [min(b[0], INF) for b in best], [ranked.index(b[1:]) for b in best]
    return cost, rank


def backward(steps: Sequence[Step], cost: Sequence[int]) -> list[int]:
    """Least cost of going on to the end from every state before the steps."""
    cost = list(cost)
    for c, _ in reversed(steps):
        cost = [min(INF, min(c[p][t] + cost[t] for t in STATES)) for p in STATES]
    return cost


def entered(state: int) -> list[int]:
    return [0 if s == state else INF for s in STATES]


def crossings(steps: Sequence[Step], entry: int, close: Sequence[int]) -> list[int]:
    """State after each step on the cheapest way from ``entry``; of equally cheap ones, the one with the least edits."""
    out = [entry] * len(steps)

    def cross(low: int, middle: int, high: int, entry: int, close: Sequence[int]) -> int:
        cost, rank = forward(steps[low:middle], entered(entry), STATES)
        rest = backward(steps[middle:high], close)
        return min(STATES, key=lambda s: (cost[s] + rest[s], rank[s]))

    if not out:
        return out
    out[-1] = cross(0, len(steps), len(steps), entry, close)
    jobs = [(0, len(steps), entry, out[-1])]
    while jobs:
        low, high, first, last = jobs.pop()
        if high - low > 1:
            middle = (low + high) // 2
            out[middle - 1] = state = cross(low, middle, high, first, entered(last))
            jobs += [(low, middle, first, state), (middle, high, state, last)]
    return out


def summary(codes: str) -> Step:
    """One step over many turns."""
    steps = [turn_step(c)[0] for c in codes]
    found = [forward(steps, entered(p), STATES) for p in STATES]
    return tuple(tuple(c) for c, _ in found), tuple(tuple(r) for _, r in found)


@lru_cache(maxsize=20_000)
def repair(codes: str, entry: int = 0, last: int | None = None) -> list[tuple[int, str]]:
    """State before each turn and its edits, inserted turns first; with ``last`` given, the state to end in."""
    after = crossings([turn_step(c)[0] for c in codes], entry, CLOSE if last is None else entered(last))
    before = [entry, *after[:-1]]
    return [(p, turn_step(c)[1][p][t]) for c, p, t in zip(codes, before, after)]


def damaged(turns: DataFrame) -> DataFrame:
    """The turns after damage by the CRC-32 of ``conv_id:turn``, modulo 20; NULLs are one space.

    0 drops the turn, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 gives it to the user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", blank("conv_id"), blank("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def in_chunks(turns: DataFrame, chunk_rows: int, chunk_bytes: int, folder: str) -> DataFrame:
    """``conv_id, turn, role, text, chunk, at, code, fault``: written in order, cut into chunks.

    Chunks are numbered in the order of conversations and turns (NULLs first, then by role and text), and ``at``
    counts from 0 in each.  Equal rows of one turn may lie in several partitions.  ``fault`` is the first that applies.
    """
    spaces = F.lit(SPACES)
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("salt"),
    )
    # The first of equal turns of a conversation; a common text is a key of its own in each conversation.
    said = Window.partitionBy("conv_id", "role", "text").orderBy("turn", "salt")
    rows = rows.withColumn("seen", F.row_number().over(said) > 1)
    end = F.right(F.rtrim("text", spaces), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    # The first of equal turns comes first.
    keys = ["conv_id", "turn", "role", "text", "seen", "salt"]
    ordered = rows.withColumn("fault", fault).withColumn(
        "code", F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    ).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("seen", "salt")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, size, now = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            convs, lengths = batch.column(0).to_pylist(), pc.binary_length(batch.column(3)).to_pylist()
            chunks, places = [], []
            for conv, length in zip(convs, lengths):
                if at >= 0 and (conv != now or at + 1 >= chunk_rows or size + length > chunk_bytes):
                    chunk, at, size = chunk + 1, -1, 0
                now, at, size = conv, at + 1, size + length
                chunks.append(chunk)
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())],
                names=[*batch.schema.names, "chunk", "at"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return written(ordered.mapInArrow(number, f"{schema}, chunk long, at int"), f"{folder}/turns")


def chunk_states(chunks: DataFrame) -> DataFrame:
    """``chunk, first, last``: the states at both ends of each ``conv_id, chunk, codes``; ``last`` is NULL for a final one."""
    id_type = chunks.schema["conv_id"].dataType.simpleString()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(codes) for codes in batch.column(2).to_pylist()]
            flat = [[[x for row in part for x in row] for part in step] for step in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in flat], pa.list_(pa.int64())),
                 pa.array([f[1] for f in flat], pa.list_(pa.int64()))],
                names=["conv_id", "chunk", "cost", "order"],
            )

    def cross(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        square = lambda x: tuple(tuple(x[4 * p:4 * p + 4]) for p in STATES)
        steps = [(square(c), square(o)) for c, o in zip(rows.column("cost").to_pylist(), rows.column("order").to_pylist())]
        after = crossings(steps, 0, CLOSE)
        return pa.table(
            [rows.column("chunk"), pa.array([0, *after[:-1]], pa.int32()), pa.array([*after[:-1], None], pa.int32())],
            names=["chunk", "first", "last"],
        )

    several = Window.partitionBy("conv_id")
    counted = chunks.withColumn("n", F.count(F.lit(1)).over(several))
    single = counted.where("n = 1").select("chunk", F.lit(0).alias("first"), F.lit(None).cast("int").alias("last"))
    summed = counted.where("n > 1").select("conv_id", "chunk", "codes").mapInArrow(
        sum_up, f"conv_id {id_type}, chunk long, cost array<long>, `order` array<long>"
    )
    return single.union(summed.groupBy("conv_id").applyInArrow(cross, "chunk long, first int, last int"))


def with_edits(turns: DataFrame, chunk_rows: int = 4096, chunk_bytes: int = 1 << 24, folder: str | None = None) -> DataFrame:
    """Every turn with its place, fault and cheapest edits.

    ``conv_id, turn, role, text, fault, code, chunk, at`` and ``state`` (before the turn), ``edits`` (initials, inserted
    turns first), ``closing`` (inserts behind a conversation's last turn).  The order of a conversation is that of
    ``chunk, at``: by turn, NULLs first, then by role and text.

    NULL roles and texts are one space.  Rows whose conversation is NULL are one conversation.  Repeated rows are
    duplicates.  Empty texts are blank; texts and conversations may be of any length: a task holds ``chunk_rows`` turns
    or ``chunk_bytes`` of text, or the summaries of one conversation's chunks.  Other columns are not read, whatever
    their names.  An empty table gives no rows.
    """
    folder = folder or run_path(turns.sparkSession, "conversations")
    placed = in_chunks(turns, chunk_rows, chunk_bytes, folder)
    gathered = placed.groupBy("chunk").agg(
        F.first("conv_id").alias("conv_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes")
    ).select("conv_id", "chunk", "codes")
    chunks = written(gathered, f"{folder}/chunks")
    states = chunk_states(chunks)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, codes, first, last in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = repair(codes, first, last)
                end = ""
                if last is None:
                    p, e = found[-1]
                    end = CLOSING[run_edits(p, codes[-1], e)]
                out += [(chunk, i, p, e, end if i == len(found) - 1 else "") for i, (p, e) in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()])],
                names=["chunk", "at", "state", "edits", "closing"],
            )

    solved = chunks.join(states, "chunk").select("chunk", "codes", "first", "last").mapInArrow(
        solve, "chunk long, at int, state int, edits string, closing string"
    )
    return placed.join(solved, ["chunk", "at"])


def run_edits(state: int, code: str, edits: str) -> int:
    """State after the edits of one turn."""
    for e in edits:
        if e == "K" and code.lower() == "s":
            state = 1
        elif e != "D":
            state = NEXT[state]
    return state


def repaired_turns(edited: DataFrame) -> DataFrame:
    """``conv_id, chunk, at, k, role, text``: the turns after repair, in the order of ``chunk, at, k``."""
    inserted = F.length("edits") - 1
    fits = lambda s: F.when(s == 2, F.lit("assistant")).otherwise(F.lit("user"))
    # After i inserts the state alternates between 2 and 3, from 0 and 1 as from 3.
    after = lambda i: F.when(i == 0, F.col("state")).when((F.col("state") == 2) == (i % 2 == 1), 3).otherwise(2)
    op = F.right("edits", F.lit(1))
    none = F.expr("filter(array(struct('' as role, '' as text)), x -> false)")
    fill = F.when(inserted > 0, F.transform(F.sequence(F.lit(0), inserted - 1), lambda i: F.struct(fits(after(i)).alias("role"), F.lit("").alias("text")))).otherwise(none)
    role = F.when(op == "K", F.col("role")).otherwise(fits(after(inserted)))
    own = F.when(op != "D", F.array(F.struct(role.alias("role"), F.col("text").alias("text")))).otherwise(none)
    last = F.when(F.col("closing") == "II", F.array(*(F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in ("user", "assistant")))).when(
        F.col("closing") == "I", F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("text")))
    ).otherwise(none)
    return edited.select("conv_id", "chunk", "at", F.posexplode(F.concat(fill, own, last)).alias("k", "turn")).select("conv_id", "chunk", "at", "k", "turn.role", "turn.text")


#: Cost of each edit by its initial.
COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def reports(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns``: its faults, the edits and the digest of its repaired turns.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  The digest reads the turns of
    a conversation one after the other, none is held.  A conversation without edited turns has zeros.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "role", "text", "fault", "code", "state", "edits", "closing"]

    class Tally:
        def __init__(self, conv):
            self.conv, self.low, self.high, self.turns, self.last = conv, None, None, 0, None
            self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            self.illegal = self.cost = 0
            self.before, self.audit, self.digest, self.begun = None, [], hashlib.sha256(), False

        def say(self, role: str, text: str) -> None:
            self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
            self.begun = True

        def add(self, turn, role, text, fault, code, state, edits, closing) -> None:
            if turn is not None and turn != self.last:
                self.turns, self.last, self.high = self.turns + 1, turn, turn
                self.low = turn if self.low is None else self.low
            if fault:
                self.faults[fault] += 1
            initial = role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            self.audit += [edits, closing]
            self.cost += sum(COSTS[e] for e in edits + closing) + (TRUNCATED if fault == "truncated" and edits[-1] != "D" else 0)
            for e in edits + closing:
                if e in "IR":
                    self.say(ROLES[FITS[state]], "" if e == "I" else text)
                elif e == "K":
                    self.say(role, text)
                state = run_edits(state, code, e)

        def row(self) -> tuple:
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, done, type_ = None, [], None

        def rows() -> pa.RecordBatch:
            kinds = [type_, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            type_ = batch.schema.field(0).type
            for conv, *turn in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                if tally is None or conv != tally.conv:
                    if tally:
                        done.append(tally.row())
                    tally = Tally(conv)
                tally.add(*turn)
            if done:
                yield rows()
                done = []
        if tally:
            done.append(tally.row())
            yield rows()

    ordered = edited.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at").select(*columns)
    told = ordered.mapInArrow(tell, f"conv_id {id_type}, {REPORT}").withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    zeros = {c.split()[0]: 0 for c in REPORT.split(", ")[:6]} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.join(told, every["conv_id"].eqNullSafe(told["_conv"]), "left").drop("_conv").na.fill(zeros, list(zeros))
