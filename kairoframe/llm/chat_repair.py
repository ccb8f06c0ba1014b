"""Chat formatting: repair the roles of a conversation at the least cost, then render it.

A legal conversation is an automaton: an optional system turn, then user and assistant in alternation, beginning with user and
ending with assistant. Each turn is given a role (another than its own costs RELABEL) and is either appended or merged into the turn
before it if that has the same role (costs MERGE); empty turns are inserted where the automaton needs them (INSERT each).
Dynamic programming finds the cheapest choice; of equally cheap ones the first of: keep, merge, relabel, insert.

A conversation may be of any length: it is cut into stretches of ``stretch`` rows; each stretch yields a matrix of least costs from every
entry state to every exit state, the few matrices of a conversation are chained (min-plus), which fixes the states at the stretch's
ends, and every stretch is then repaired on its own. Only stretches are ever gathered in one task: rows are numbered in an order that is range-partitioned, so that
a conversation of very many rows (as those without an id may be) spreads over partitions.

Cases: rows given twice count once; turns that share a number are ordered by role and text; a null turn number comes first; null
text is empty; a role that is null or unknown has to be relabelled; turns without a conversation id form one conversation, with null
id; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.llm.storage import write_shared

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40
ENDS = (START, ASSISTANT)


def _fillers(state: int, target: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which target may follow state; None: none lead there."""
    paths = [((), state)]
    for _ in range(4):
        for path, at in paths:
            if target in NEXT[at]:
                return path
        paths = [((*path, n), n) for path, at in paths for n in NEXT[at]]
    return None


FILLERS = {(s, t): _fillers(s, t) for s in range(4) for t in (SYSTEM, USER, ASSISTANT)}
CLOSING = {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}


def _moves(own: int) -> list[list[tuple[int, int, int]]]:
    """For a turn of role own (0: unknown), by state before it: (cost, rank, state after), where the rank encodes merge and relabel."""
    out = []
    for state in range(4):
        moves = []
        for target in (SYSTEM, USER, ASSISTANT):
            relabel = RELABEL * (target != own)
            if target == state:
                moves.append((MERGE + relabel, 1 + 2 * (target != own), target))
            if (path := FILLERS[state, target]) is not None:
                moves.append((INSERT * len(path) + relabel, 2 * (target != own) + 4 * len(path), target))
        out.append(sorted(moves, key=lambda m: (m[1], m[2])))
    return out


MOVES = {own: _moves(own) for own in range(4)}
NUMBER = {None: 0, "system": SYSTEM, "user": USER, "assistant": ASSISTANT}


def to_go(own: list[int], final: list[int]) -> list[list[int]]:
    """Least cost from each state before each turn to the end, where state s costs final[s]."""
    table = [final]
    for role in reversed(own):
        after = table[-1]
        table.append([min((cost + after[t] for cost, _, t in moves), default=NEVER) for moves in MOVES[role]])
    return table[::-1]


def matrix(own: list[int]) -> list[int]:
    """Least costs from every entry to every exit state, row by row."""
    columns = [to_go(own, [0 if s == e else NEVER for s in range(4)])[0] for e in range(4)]
    return [min(columns[e][s], NEVER) for s in range(4) for e in range(4)]


def chain(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """The entry and exit states of consecutive stretches on a cheapest way from START to a state, closing turns counted."""
    table = [[INSERT * len(CLOSING[s]) for s in range(4)]]
    for m in reversed(matrices):
        table.append([min(m[4 * s + e] + table[-1][e] for e in range(4)) for s in range(4)])
    state, ends = START, []
    for i, m in enumerate(matrices):
        after = table[len(matrices) - 1 - i]
        exit_ = min(range(4), key=lambda e: (m[4 * state + e] + after[e], e))
        ends.append((state, exit_))
        state = exit_
    return ends


def repair_stretch(own: list[int], entry: int, exit_: int, last: bool) -> Iterator[tuple[int, int, str, int]]:
    """(index of the turn or -1, role, action, cost) of every turn that comes out; actions: keep, merge, relabel, relabel_merge, insert."""
    table = to_go(own, [0 if s == exit_ else NEVER for s in range(4)])
    state = entry
    for i, role in enumerate(own):
        cost, rank, target = next(m for m in MOVES[role][state] if m[0] + table[i + 1][m[2]] == table[i][state])
        if not rank & 1:
            for filler in FILLERS[state, target]:
                yield -1, filler, "insert", INSERT
                cost -= INSERT
        yield i, target, ("keep", "merge", "relabel", "relabel_merge")[rank & 3], cost
        state = target
    if last:
        for filler in CLOSING[state]:
            yield -1, filler, "insert", INSERT


def numbered(turns: DataFrame, kind: str) -> DataFrame:
    """The turns in order of conversation, turn, role and text, with ``part``, the range they fell into, and ``number``, counted from 0 in
    each conversation's rows of a part."""
    names = ["conv_id", "turn", "role", "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, conv = -1, None
        for batch in batches:
            numbers = []
            for own in batch.column(0).to_pylist():
                n, conv = (n + 1 if own == conv else 0), own
                numbers.append(n)
            columns = [*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "part", "number"])

    ordered = turns.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)
    return ordered.mapInArrow(count, f"conv_id {kind}, turn long, role string, text string, part int, number long")


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = 4096) -> DataFrame:
    """The repaired turns: conv_id, stretch, position (in the stretch), role, action, cost, text. Merged turns stay rows of their own, marked
    by their action; render() joins them."""
    kind = conversations.schema[conv_id].dataType.simpleString()
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    turns = write_shared(numbered(turns, kind), "turns")
    # The parts that go on with a conversation of the part before: one a part at most.
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before")).where("before > 0")
    turns = turns.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    turns = turns.withColumn("number", F.col("number") + F.coalesce("before", F.lit(0))).withColumn("stretch", F.floor(F.col("number") / stretch).cast("long"))
    turns = turns.select("conv_id", "stretch", "number", "role", "text")
    dealt = turns.select("conv_id", "stretch", "number", "role").repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "number")

    def stretches(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]):
        rows = (r for b in batches for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)))
        return groupby(rows, key=lambda r: r[:2])

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, part), rows in stretches(batches, ("conv_id", "stretch", "role")):
            out.append((conv, part, matrix([NUMBER.get(r[2], 0) for r in rows])))
            if len(out) == 4096:
                yield table(out, matrix_schema)
                out = []
        yield table(out, matrix_schema)

    def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(conversations.schema[conv_id].dataType)
    matrix_schema = pa.schema([("conv_id", id_type), ("stretch", pa.int64()), ("costs", pa.list_(pa.int64()))])
    ends_schema = pa.schema([("conv_id", id_type), ("stretch", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())])
    out_schema = pa.schema([("conv_id", id_type), ("stretch", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("text", pa.string())])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for conv, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            ends = chain([r[2] for r in group])
            yield table([(conv, r[1], *e, i == len(group) - 1) for i, (r, e) in enumerate(zip(group, ends))], ends_schema)

    matrices = dealt.select("conv_id", "stretch", "role").mapInArrow(costs, f"conv_id {kind}, stretch long, costs array<long>")
    ends = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(chained, f"conv_id {kind}, stretch long, entry int, exit int, last boolean")
    ends = write_shared(ends, "stretch-ends")
    named = ends.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "entry", "exit", "last")
    joined = turns.join(named, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).drop("c", "s")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, part), rows in stretches(batches, ("conv_id", "stretch", "role", "text", "entry", "exit", "last")):
            rows = list(rows)
            _, _, _, _, entry, exit_, last = rows[0]
            for position, (i, role_, action, cost) in enumerate(repair_stretch([NUMBER.get(r[2], 0) for r in rows], entry, exit_, last)):
                out.append((conv, part, position, ROLES[role_ - 1], action, cost, rows[i][3] if i >= 0 else ""))
            if len(out) >= 4096:
                yield table(out, out_schema)
                out = []
        yield table(out, out_schema)

    again = joined.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "number")
    return again.mapInArrow(repaired, f"conv_id {kind}, stretch long, position long, role string, action string, cost long, text string")


def rendered(repaired: DataFrame) -> DataFrame:
    """Every repaired turn with ``piece``, its part of the rendered text; a conversation's text is its pieces in order of (stretch, position)."""
    opening = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    piece = F.when(F.col("action").isin("merge", "relabel_merge"), F.concat(F.lit("\n"), "text")).otherwise(F.concat(opening, "text"))
    return repaired.withColumn("piece", piece)
