"""Chat formatting (operator 7) by minimum-cost role repair.

A legal conversation is: a system turn or none, then user and assistant turns in alternation, an assistant turn
last. A dynamic programme over that automaton picks, for each turn, to keep it, to merge it into the turn before
(same role), to relabel it, or to insert an empty turn of the missing role first, at least total cost; ties go
to the least state, then the first action in :data:`ACTIONS`. The repaired sequence is rendered.

Costs depend on the roles alone, so a stretch of turns is a min-plus matrix over four states. Conversations are cut
into parts of ``PART`` turn numbers: matrices of parts are made from narrow rows, a conversation's parts are
chained (one small row each), and then every part is repaired for itself between known states. No task holds the
texts of a long conversation. The result is a row for each part: the renderings of a conversation's parts, in order
and joined, are its rendering; all but giant conversations have one part.

Null or unknown roles may take any role at a small cost. Null texts render as empty. Null turns come first; turns
of equal number are ordered by role and text. A turn of null conv_id belongs to nothing: it is a conversation of its own, repaired where it
is, so however many there are, no task gathers them. ``<|`` in texts is written ``< |``. Repeated rows are turns of their own; the empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_schema, conform, map_batches

PART = 4096
SYSTEM, USER, ASSISTANT, OTHER = 0, 1, 2, 3
NAMES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "developer": "system", "instruction": "system"}
#: States: the role of the last turn; START before any.
START = 3
STATES = 4
ACTIONS = ("keep", "merge", "relabel", "insert")
MERGE, INSERT, UNKNOWN = 1.0, 2.5, 0.5
RELABEL = {(USER, ASSISTANT): 3.0, (ASSISTANT, USER): 3.0, (SYSTEM, USER): 1.5, (SYSTEM, ASSISTANT): 4.0, (USER, SYSTEM): 4.0, (ASSISTANT, SYSTEM): 4.0}
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Cost of ending in a state, and the empty turns that are put there.
ENDS = {START: (0.0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0.0, ())}
INF = float("inf")


def moves(said: int) -> list[list[tuple[float, tuple[int, ...], int, str] | None]]:
    """[state before][state after] -> (cost, empty turns put first, role taken, action) of the cheapest way to take a turn."""
    out: list[list] = [[None] * STATES for _ in range(STATES)]
    for before, role in product(range(STATES), (SYSTEM, USER, ASSISTANT)):
        taking = 0.0 if role == said else UNKNOWN if said == OTHER else RELABEL[said, role]
        ways = []
        if role in FOLLOWS[before]:
            ways.append((taking, (), role, "keep" if role == said else "relabel"))
        if role == before:
            ways.append((taking + MERGE, (), role, "merge"))
        ways += [(taking + INSERT, (empty,), role, "insert") for empty in FOLLOWS[before] if role in FOLLOWS[empty]]
        for way in ways:
            if out[before][role] is None or (way[0], ACTIONS.index(way[3])) < (out[before][role][0], ACTIONS.index(out[before][role][3])):
                out[before][role] = way
    return out


MOVES = [moves(r) for r in range(4)]


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return NAMES.index(name) if name in NAMES else OTHER


def forward(costs: list[float], said: int) -> tuple[list[float], list[int]]:
    """Costs after one more turn, and the state each came from."""
    out, came = [INF] * STATES, [-1] * STATES
    for before, row in enumerate(MOVES[said]):
        for after, way in enumerate(row):
            if way is not None and costs[before] + way[0] < out[after]:
                out[after], came[after] = costs[before] + way[0], before
    return out, came


def matrix(roles: list[int]) -> list[float]:
    """Row-major least costs from each state to each over the turns."""
    out = []
    for start in range(STATES):
        costs = [0.0 if s == start else INF for s in range(STATES)]
        for said in roles:
            costs, _ = forward(costs, said)
        out += costs
    return out


def chain(matrices: list[list[float]]) -> tuple[float, list[int]]:
    """Least cost of a conversation of such parts, and the states at the edges of the parts."""
    costs, back = [0.0 if s == START else INF for s in range(STATES)], []
    for m in matrices:
        new, came = [INF] * STATES, [-1] * STATES
        for before, after in product(range(STATES), repeat=2):
            if costs[before] + m[before * STATES + after] < new[after]:
                new[after], came[after] = costs[before] + m[before * STATES + after], before
        costs = new
        back.append(came)
    last = min(range(STATES), key=lambda s: costs[s] + ENDS[s][0])
    edges = [last]
    for came in reversed(back):
        edges.append(came[edges[-1]])
    return costs[last] + ENDS[last][0], edges[::-1]


def repair(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[float, tuple[int, ...], int, str]]:
    """The cheapest ways of the turns from ``start`` to ``end`` (None: whichever ends cheapest)."""
    costs, back = [0.0 if s == start else INF for s in range(STATES)], []
    for said in roles:
        costs, came = forward(costs, said)
        back.append(came)
    if end is None:
        end = min(range(STATES), key=lambda s: costs[s] + ENDS[s][0])
    out = []
    for said, came in zip(reversed(roles), reversed(back)):
        out.append(MOVES[said][came[end]][end])
        end = came[end]
    return out[::-1]


def turn_text(role: int, text: str) -> str:
    return f"<|{NAMES[role]}|>\n{text}\n"


def render(ways: list[tuple], texts: list[str | None], ending: tuple[int, ...] = ()) -> str:
    parts = []
    for (_, empty, role, action), text in zip(ways, texts):
        text = (text or "").replace("<|", "< |")
        parts += [turn_text(e, "") for e in empty]
        parts.append(f"{text}\n" if action == "merge" else turn_text(role, text))
    return "".join([*parts, *(turn_text(e, "") for e in ending)])


TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
STRETCH = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("costs", T.ArrayType(T.DoubleType()))])
EDGE = T.StructType([T.StructField("conv", T.LongType()), T.StructField("of_part", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("last", T.BooleanType())])
FORMATTED = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("cost", T.DoubleType())]
    + [T.StructField(f"n_{a}", T.LongType()) for a in ACTIONS]
    + [T.StructField("rendered", T.StringType())]
)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys of sorted batches."""
    now, rows = None, []
    for batch in batches:
        for x in zip(*(batch[c].to_pylist() for c in keys + rest)):
            if x[: len(keys)] != now:
                if rows:
                    yield now, rows
                now, rows = x[: len(keys)], []
            rows.append(x[len(keys) :])
    if rows:
        yield now, rows


def batched(rows: Iterator[tuple], schema: T.StructType, size: int = 500) -> Iterator[pa.RecordBatch]:
    out, held = arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation part: how it was repaired and its rendering."""
    every = conform(turns, TURN)
    rows = every.where("conv_id is not null").withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / PART).cast("long"))
    order = ["conv_id", "part", "turn", "role"]

    def stretches(batches):
        for_each = grouped(batches, ("conv_id", "part"), ("role",))
        return batched(((*key, matrix([role_of(r) for (r,) in group])) for key, group in for_each), STRETCH)

    narrow = rows.select("conv_id", "part", "turn", "role").repartition("conv_id", "part").sortWithinPartitions(*order).mapInArrow(stretches, STRETCH)
    chained = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("parts"))  # one small row a part

    def edges(batches):
        def each():
            for batch in batches:
                for conv, parts in zip(batch["conv_id"].to_pylist(), batch["parts"].to_pylist()):
                    _, states = chain([p["costs"] for p in parts])
                    for k, p in enumerate(parts):
                        yield conv, p["part"], states[k], states[k + 1], k + 1 == len(parts)

        return batched(each(), EDGE, 5000)

    known = chained.mapInArrow(edges, EDGE)
    placed = rows.join(known, (F.col("conv_id") == F.col("conv")) & (F.col("part") == F.col("of_part"))).drop("conv", "of_part")

    def told(conv: int | None, part: int, roles: list[int], texts: list[str | None], start: int, end: int, last: bool) -> tuple:
        ways = repair(roles, start, end)
        ending = ENDS[end][1] if last else ()
        counts = [sum(w[3] == a for w in ways) for a in ACTIONS]
        counts[3] += len(ending)
        return conv, part, len(roles), sum(w[0] for w in ways) + INSERT * len(ending), *counts, render(ways, texts, ending)

    def lone(batches):
        def each():
            for batch in batches:
                for turn, name, text in zip(*(batch[c].to_pylist() for c in ("turn", "role", "text"))):
                    role = role_of(name)
                    _, (start, end) = chain([matrix([role])])
                    yield told(None, (turn or 0) // PART, [role], [text], start, end, True)

        return batched(each(), FORMATTED)

    def formatted(batches):
        def each():
            for (conv, part), group in grouped(batches, ("conv_id", "part"), ("role", "text", "start", "end", "last")):
                start, end, last = group[0][2:]
                yield told(conv, part, [role_of(g[0]) for g in group], [g[1] for g in group], start, end, last)

        return batched(each(), FORMATTED)

    whole = placed.repartition("conv_id", "part").sortWithinPartitions(*order, "text").mapInArrow(formatted, FORMATTED)
    return whole.unionAll(every.where("conv_id is null").mapInArrow(lone, FORMATTED))
