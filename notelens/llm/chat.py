"""Operator 6: repair of the roles of conversations at minimum cost, and rendering.

A legal conversation has at most one system turn, at its start, then user and assistant
turns in alternation, and ends with an assistant turn. An automaton whose state is the
role of the last message accepts just these. A repair reads the turns in order; each
turn becomes a message of its role, becomes one of another role (a relabel), or is
joined to the message before it (a merge), and empty messages may be inserted before a
turn and at the end. Dynamic programming over the automaton's states finds a repair of
the least cost; of equally cheap ones it takes the one whose choices come first in the
order keep, merge, relabel, insert, turn by turn from the end.

The steps of a stretch of turns form a min-plus matrix over the states, and matrices of
neighbouring stretches multiply. So conversations are cut at every ``STRETCH`` turn
numbers, and again at every ``STRETCH`` rows where more share these numbers (repeated or
null ones); each stretch gives its matrix from its roles, the matrices of a conversation
give the states at the cuts, and every stretch is then repaired between its states on its
own. No array holds more than ``STRETCH`` texts. A conversation of ordinary length is one
stretch, and its row holds the whole rendering; longer ones have a row for each stretch,
whose renderings follow one another.

Up to ``WIDE`` rows under the same ``STRETCH`` numbers are ranked by one task; more are
sorted in ranges of turn, role and the first ``PREFIX`` characters of the text. Only rows
of one turn that are equal in all of these, but not in the rest of the text, are sorted
by one task (on disk where needed); their stretches are spread like all others.

Turns are ordered by number (nulls first), then role and text; rows that repeat all of
conversation, turn, role and text count once. Roles are compared in lower case without
spaces around; other and null roles cost less to relabel, as any role may be right. Null
texts are empty. Rows with a null conversation are the turns of one conversation with a
null id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, staged

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Messages that may follow each state, and the states that a conversation may end in.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (ASSISTANT,)
#: Costs: a merge of turns of one role, a merge of a turn of another role, a relabel, the same for unknown roles, an empty message.
MERGE, MERGE_OTHER, RELABEL, UNKNOWN, INSERT = 10, 25, 20, 5, 15
#: Turn numbers of a stretch, and rows at most.
STRETCH = 512
#: Rows under the turn numbers of a stretch that one task ranks, characters of the text that ranges are cut by, ranges at most.
WIDE, PREFIX, RANGES = 8 * STRETCH, 256, 5000
FAR = 1 << 50


def role_code(role: str | None) -> int:
    """The state of a role; 0 for roles that are not known."""
    return ROLES.get((role or "").strip().lower(), 0)


def _fill(source: int, target: int) -> tuple[int, ...] | None:
    """The shortest run of empty messages that leads from a state to one that ``target`` may follow."""
    paths = [()] + [(a,) for a in FOLLOWS[source]] + [(a, b) for a in FOLLOWS[source] for b in FOLLOWS[a]]
    fits = [p for p in paths if target in FOLLOWS[p[-1] if p else source]]
    return min(fits, key=len, default=None)


_FILLS = {(s, t): _fill(s, t) for s, t in product(range(4), (SYSTEM, USER, ASSISTANT))}


def choices(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(rank, from, to, name, inserted) of all steps that read a turn of a role, with their cost in front."""
    out = []
    for state in range(4):
        if state != START:
            cost = UNKNOWN if role == 0 else MERGE if state == role else MERGE_OTHER
            out.append((cost, 1, state, state, "merge", ()))
        for target in (SYSTEM, USER, ASSISTANT):
            fill = _FILLS[state, target]
            if fill is None:
                continue
            same = role == target
            cost = INSERT * len(fill) + (0 if same else UNKNOWN if role == 0 else RELABEL)
            out.append((cost, 3 if fill else 0 if same else 2, state, target, "keep" if same else "relabel", fill))
    return out


_CHOICES = {role: choices(role) for role in range(4)}


def matrix(roles: list[int]) -> list[int]:
    """Least costs from each state to each other over a stretch, row after row."""
    cost = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for role in roles:
        new = [[FAR] * 4 for _ in range(4)]
        for price, _, a, b, _, _ in _CHOICES[role]:
            for start in range(4):
                if cost[start][a] + price < new[start][b]:
                    new[start][b] = cost[start][a] + price
        cost = new
    return [c for row in cost for c in row]


def end_fill(state: int) -> tuple[int, ...]:
    """Empty messages that end a conversation; an empty one stays empty."""
    if state in ENDS or state == START:
        return ()
    paths = [(a,) for a in FOLLOWS[state]] + [(a, b) for a in FOLLOWS[state] for b in FOLLOWS[a]]
    return min((p for p in paths if p[-1] in ENDS), key=len)


def cuts(matrices: list[list[int]]) -> tuple[list[int], int]:
    """The states before, between and after the stretches of a cheapest repair, and its cost with the end's insertions."""
    best = [[0 if s == START else FAR for s in range(4)]]
    for m in matrices:
        best.append([min(best[-1][a] + m[4 * a + b] for a in range(4)) for b in range(4)])
    total = [best[-1][s] + INSERT * len(end_fill(s)) for s in range(4)]
    states = [min(range(4), key=lambda s: (total[s], s))]
    cost = total[states[0]]
    for k in range(len(matrices) - 1, -1, -1):
        b = states[-1]
        states.append(min(range(4), key=lambda a: (best[k][a] + matrices[k][4 * a + b], a)))
    return states[::-1], cost


def path(roles: list[int], start: int, end: int) -> list[tuple[str, int, tuple[int, ...]]]:
    """(name, state after, inserted before) of every turn of a stretch on a cheapest way between two states."""
    best, back = [FAR] * 4, []
    best[start] = 0
    for role in roles:
        new, step = [(FAR, 9)] * 4, [None] * 4
        for price, rank, a, b, name, fill in _CHOICES[role]:
            if best[a] < FAR and (best[a] + price, rank) < new[b]:
                new[b], step[b] = (best[a] + price, rank), (a, name, fill)
        best = [c for c, _ in new]
        back.append(step)
    out = []
    for step in reversed(back):
        before, name, fill = step[end]
        out.append((name, end, fill))
        end = before
    return out[::-1]


def render(turns: list[tuple[int, str]], start: int, end: int, last: bool) -> tuple[str, list[str], int]:
    """The rendering of a stretch, the name of what became of each turn, and the number of messages that begin in it."""
    steps = path([r for r, _ in turns], start, end)
    out, names, messages = [], [], 0
    opened = start != START

    def begin(role: int) -> None:
        nonlocal opened, messages
        out.append(("<|im_end|>\n" if opened else "") + f"<|im_start|>{NAMES[role]}\n")
        opened, messages = True, messages + 1

    for (_, text), (name, state, fill) in zip(turns, steps):
        for role in fill:
            begin(role)
        if name == "merge":
            out.append("\n" + text)
        else:
            begin(state)
            out.append(text)
        names.append("+" * len(fill) + name)
    if last:
        for role in end_fill(end):
            begin(role)
            names.append("+")
        if opened:
            out.append("<|im_end|>\n")
    return "".join(out), names, messages


def _ranked(turns: DataFrame, large: DataFrame, wide: int) -> DataFrame:
    """``turns`` with ``_rank``, the number of rows before each under the same (conv_id, part), by a sort in ranges."""
    ranges = min(RANGES, -(-large.agg(F.sum("count")).first()[0] // wide))
    order = ["conv_id", "part", "turn", "role"]
    dealt = turns.repartitionByRange(max(1, ranges), *order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    placed = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered-turns").withColumn("_range", F.shiftright("_at", 33))
    found = placed.groupBy("conv_id", "part", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv_id", "part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    a, b = placed.alias("a"), found.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a._range") == F.col("b._range"))
    return a.join(b, same).select("a.conv_id", "a.turn", "a.role", "a.text", "a.part", (F.col("_at") - F.col("_first") + F.col("_before")).alias("_rank"))


def stretches(turns: DataFrame, stretch: int = STRETCH, wide: int = WIDE) -> DataFrame:
    """``conv_id``, ``part``, ``sub`` (a stretch's place, in this order) and ``turns`` (its rows in order, ``stretch`` at most)."""
    part = F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(1 << 62))).cast("bigint")
    own = turns.select("conv_id", "turn", "role", "text", part.alias("part"))
    large = staged(own.groupBy("conv_id", "part").count().filter(F.col("count") > wide), "large-stretches")
    some = not large.isEmpty()
    a, b = own.alias("a"), F.broadcast(large).alias("b")  # one row for more than ``wide`` rows of the table
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part"))
    rest = (a.join(b, same, "left_anti") if some else own).distinct()
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")) - 1
    ranked = rest.withColumn("_rank", rank.cast("bigint"))
    if some:
        ranked = ranked.unionByName(_ranked(a.join(b, same, "left_semi").distinct(), large, wide))
    sub = F.floor(F.col("_rank") / stretch).cast("bigint")
    return ranked.groupBy("conv_id", "part", sub.alias("sub")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))


def repair(turns: DataFrame, stretch: int = STRETCH, wide: int = WIDE) -> DataFrame:
    """A row for every stretch: ``conv_id``, ``part`` (number of the stretch), ``n_turns``, ``n_messages`` that begin in it,
    ``steps`` (what became of each turn; a plus for each empty message), ``cost`` of the whole conversation, ``rendered``."""
    parts = staged(stretches(turns, stretch, wide), "stretches")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matrix([role_code(r) for r in roles]) for roles in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["conv_id", "part", "sub", "matrix"])

    key = [turns.schema["conv_id"], T.StructField("part", T.LongType())]
    place = [*key, T.StructField("sub", T.LongType())]
    steps = map_rows(parts.select("conv_id", "part", "sub", F.col("turns.role")), matrices, [*place, T.StructField("matrix", T.ArrayType(T.LongType()))])
    listed = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "sub", "matrix"))).alias("steps"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for conv, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, cost = cuts([f["matrix"] for f in found])
                for k, f in enumerate(found):
                    for column, value in zip(out, (conv, f["part"], f["sub"], k, at[k], at[k + 1], cost, k == len(found) - 1)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(0).type), *[pa.array(c, pa.int64()) for c in out[1:7]], pa.array(out[7], pa.bool_())],
                ["conv_id", "part", "sub", "place", "start", "end", "cost", "last"])

    between = map_rows(listed, states, [*place, *[T.StructField(n, T.LongType()) for n in ("place", "start", "end", "cost")],
                                        T.StructField("last", T.BooleanType())])
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.sub") == F.col("b.sub"))
    a, b = parts.alias("a"), between.alias("b")
    placed = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & same).select(
        "a.conv_id", "b.place", "b.start", "b.end", "b.cost", "b.last", F.transform("a.turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                rows = []
                for _, begin, end, _, last, turns in zip(*(c.to_pylist() for c in piece.columns[1:])):
                    text, names, messages = render([(role_code(t["role"]), t["text"]) for t in turns], begin, end, last)
                    rows.append((len(turns), messages, names, text))
                n_turns, n_messages, names, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(n_turns, pa.int64()), pa.array(n_messages, pa.int64()),
                     pa.array(names, pa.list_(pa.string())), piece.column(4), pa.array(texts, pa.string())],
                    ["conv_id", "part", "n_turns", "n_messages", "steps", "cost", "rendered"])

    return map_rows(placed, write, [
        *key, T.StructField("n_turns", T.LongType()), T.StructField("n_messages", T.LongType()),
        T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("cost", T.LongType()), T.StructField("rendered", T.StringType())])
