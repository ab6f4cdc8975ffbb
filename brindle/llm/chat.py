"""Operator 8: chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, pick

ROLES = ("system", "user", "assistant")
#: Names that other chat formats use.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs of joining a turn to the one before, of an empty turn put in, and of another role.
MERGE, INSERT, RELABEL = 2, 3, 4
#: States of the automaton: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal turns: a system turn may come first; user and assistant alternate, the user first; the assistant ends.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NONE = 10**15
_NAMES = (None, *ROLES)


def role_of(name: str | None) -> int:
    """The state a role leads to; 0 for a role of no known name, which any role replaces at RELABEL."""
    low = (name or "").strip().lower()
    low = ALIASES.get(low, low)
    return ROLES.index(low) + 1 if low in ROLES else 0


def moves() -> dict[int, list[list[tuple[int, int, tuple]]]]:
    """For each given role and state before: (cost, state after, what is done), cheapest ways of taking the turn.

    What is done: (role the turn gets, whether it joins the turn before, role of an empty turn before it or 0).
    """
    table = {}
    for given in range(4):
        table[given] = []
        for before in range(4):
            ways = []
            for role in (SYSTEM, USER, ASSISTANT):
                cost = 0 if role == given else RELABEL
                if role in NEXT[before]:
                    ways.append((cost, role, (role, False, 0)))
                if role == before:
                    ways.append((cost + MERGE, role, (role, True, 0)))
                ways += [(cost + INSERT, role, (role, False, empty)) for empty in NEXT[before] if role in NEXT[empty] and role not in NEXT[before]]
            best: dict[int, tuple] = {}
            for way in ways:
                if way[1] not in best or way[0] < best[way[1]][0]:
                    best[way[1]] = way
            table[given].append([best[s] for s in sorted(best)])
    return table


_MOVES = moves()


def end_cost(state: int) -> tuple[int, tuple[int, ...]]:
    """The cost of ending after a state, and the empty turns that it takes."""
    return {START: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}[state]


def transfer(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each other over some turns; these matrices combine, in any grouping."""
    cost = [[0 if a == b else NONE for b in range(4)] for a in range(4)]
    for given in roles:
        for row in cost:
            new = [NONE] * 4
            for before in range(4):
                if row[before] < NONE:
                    for c, after, _ in _MOVES[given][before]:
                        new[after] = min(new[after], row[before] + c)
            row[:] = new
    return cost


def path(roles: list[int], entry: int, leave: int | None) -> list[tuple]:
    """What is done with each turn, from state ``entry`` to ``leave`` (None: to the cheapest end); of equal costs, the lower states."""
    costs = [[NONE] * 4]
    costs[0][entry] = 0
    for given in roles:
        new = [NONE] * 4
        for before in range(4):
            if costs[-1][before] < NONE:
                for c, after, _ in _MOVES[given][before]:
                    new[after] = min(new[after], costs[-1][before] + c)
        costs.append(new)
    state = min(range(4), key=lambda s: costs[-1][s] + end_cost(s)[0]) if leave is None else leave
    done = []
    for i in range(len(roles) - 1, -1, -1):
        state, what = next((before, w) for before in range(4) if costs[i][before] < NONE for c, after,
            w in _MOVES[roles[i]][before] if after == state and costs[i][before] + c == costs[i + 1][state])
        done.append(what)
    return done[::-1]


def opened(role: int) -> str:
    return f"<|im_start|>{_NAMES[role]}\n"


CLOSED = "<|im_end|>\n"


def _segments(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Runs of one conversation, as (first, past the last)."""
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[at][0]:
            yield at, i
            at = i


def repaired(chats: DataFrame) -> DataFrame:
    """Every turn of ``chats(conv_id, turn, role, text)`` with its place in the legal form of its conversation.

    Columns: conv_id, turn, position (rows of a conversation from 0), given_role, role (the one it gets),
    action (keep, merge, relabel, relabel+merge), inserted (roles of the empty turns put in before it,
    and after the last turn, comma-joined, or null) and rendered.  The rendered pieces of a conversation, by position,
    join to its chat text: a turn opens with its role, unless it joins the one before, which else closes.

    A conversation may hold most rows.  Rows are range-sorted, so it may span many partitions; each partition
    gives the least costs between the automaton's states over its first and last conversation, the driver
    chains these small matrices (two a partition), and each partition then finds its own turns' path
    between the states so fixed.  Turns come by turn, nulls first, then role and text; repeated rows
    are turns of their own; a null role is an unknown one; null texts are empty; null conv_ids are one
    conversation; an empty table gives an empty one; other columns are ignored.  conv_id and
    turn may be of any type that sorts.
    """
    spark = chats.sparkSession
    rows = pick(chats, "conv_id", "turn", "role", "text")
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ids = rows.schema["conv_id"].dataType.simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The conversations at the partition's two ends: whether first, how many turns, and their matrix."""
        found, part = [], None
        for b in batches:
            conv, roles = b.column(0).to_pylist(), [role_of(r) for r in b.column(2).to_pylist()]
            part = b.column(4)[0].as_py() if b.num_rows else part
            for a, z in _segments([(c,) for c in conv]):
                cost = transfer(roles[a:z])
                if found and found[-1][0] == conv[a]:
                    old = found[-1]
                    cost = [[min(min(old[2][i][m] + cost[m][j] for m in range(4)), NONE) for j in range(4)] for i in range(4)]
                    found[-1] = (conv[a], old[1] + z - a, cost)
                else:
                    found.append((conv[a], z - a, cost))
                if len(found) > 2:
                    del found[1]
        if found:
            if len(found) == 1:
                found = [*found, (None, 0, [[0] * 4] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array([f[0] for f in found],
                id_type), pa.array([f[1] for f in found], pa.int64()), pa.array([[x for row in f[2] for x in row] for f in found], pa.list_(pa.int64()))], ["part",
                "which", "conv_id", "turns", "cost"])

    id_type, turn_type = (to_arrow_type(rows.schema[n].dataType) for n in ("conv_id", "turn"))
    found = rows.mapInArrow(ends, f"part int, which int, conv_id {ids}, turns long, cost array<long>").collect()
    # the pieces of conversations that span partitions, in order
    pieces = [r for r in sorted(found, key=lambda r: (r.part, r.which)) if r.turns]
    fixed: dict[tuple, tuple] = {}  # (part, conversation): entry, leave (None: it ends here), turns before
    at = 0
    while at < len(pieces):
        end = at + 1
        while end < len(pieces) and pieces[end].conv_id == pieces[at].conv_id and pieces[end].part > pieces[end - 1].part:
            end += 1
        run = pieces[at:end]
        costs = [[0, NONE, NONE, NONE]]
        for p in run:
            costs.append([min(min(costs[-1][m] + p.cost[4 * m + j] for m in range(4)), NONE) for j in range(4)])
        state = min(range(4), key=lambda s: costs[-1][s] + end_cost(s)[0])
        states = [state]
        for i in range(len(run) - 1, -1, -1):
            states.append(next(m for m in range(4) if costs[i][m] < NONE and costs[i][m] + run[i].cost[4 * m + states[-1]] == costs[i + 1][states[-1]]))
        states.reverse()
        before = 0
        for i, p in enumerate(run):
            fixed[p.part, p.conv_id] = (states[i], states[i + 1] if i + 1 < len(run) else None, before)
            before += p.turns
        at = end
    shared = spark.sparkContext.broadcast(fixed)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            part, conv = held[0][4], held[0][0]
            entry, leave, before = shared.value.get((part, conv), (START, None, 0))
            given = [role_of(h[2]) for h in held]
            state, out = entry, []
            todo = path(given, entry, leave)
            for i, (h, g, (role, joins, empty)) in enumerate(zip(held, given, todo)):
                inserted, text = [empty] if empty else [], ""
                if joins:
                    text = "\n"
                else:
                    text = (CLOSED if state != START else "") + "".join(opened(e) + CLOSED for e in inserted) + opened(role)
                text += h[3] or ""
                if i == len(held) - 1 and leave is None:
                    after = end_cost(role)[1]
                    text += CLOSED + "".join(opened(e) + CLOSED for e in after)
                    inserted += after
                action = "+".join(["relabel"] * (role != g) + ["merge"] * joins) or "keep"
                out.append((h[0], h[1], before + i, h[2], _NAMES[role], action, ",".join(_NAMES[e] for e in inserted) or None, text))
                state = role
            held.clear()
            kinds = [id_type, turn_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
            for a in range(0, len(out), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out[a : a + 5_000]], k) for i, k in enumerate(kinds)], ["conv_id", "turn",
                    "position", "given_role", "role", "action", "inserted", "rendered"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if held and row[0] != held[0][0]:
                    yield from flush()
                held.append(row)
        yield from flush()

    turns = rows.schema["turn"].dataType.simpleString()
    return rows.mapInArrow(render, f"conv_id {ids}, turn {turns}, position long, given_role string, role string, action string, inserted string, rendered string")


def chat_texts(turns: DataFrame) -> DataFrame:
    """conv_id and the whole chat text, from ``repaired``; for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
