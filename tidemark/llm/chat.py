"""2. Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, from the user on. Each
given turn is kept, relabelled, or merged into the turn before it, and empty turns may be put in; dynamic programming
over the automaton of legal turns finds the cheapest way, and the repaired turns are rendered.

Rows are range-partitioned by conversation and turn, so one conversation may lie over many tasks. A stretch of turns
acts on the automaton as a 4 x 4 matrix of least costs. Tasks report such matrices for the first and the last
conversation of their partition only; joining those gives the state in which each stretch begins and ends, and the
tasks then repair their own stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, tasks_for

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
#: States: before any turn, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1  # what each repair costs; NAME: to give a role to a turn whose role is unknown
FAR = 1 << 40
UNKNOWN = 0  # a turn's role as a state; 0 is free, as no turn leads to START
OPEN, CLOSE, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"

Step = tuple[int, str, int]  # cost, action, role of an empty turn put in before (or 0)


def role_state(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else UNKNOWN


def _steps(role: int) -> dict[tuple[int, int], Step]:
    """The cheapest step by (state before, state after) for a turn of this role."""
    best: dict[tuple[int, int], Step] = {}

    def offer(before: int, after: int, step: Step) -> None:
        if (before, after) not in best or step[0] < best[before, after][0]:
            best[before, after] = step

    for q in (SYSTEM, USER, ASSISTANT):
        change, action = (0, "keep") if q == role else (NAME if role == UNKNOWN else RELABEL, "relabel")
        for s in NEXT:
            if q in NEXT[s]:
                offer(s, q, (change, action, 0))
            for p in NEXT[s]:
                if q in NEXT[p]:
                    offer(s, q, (change + INSERT, action, p))
        offer(q, q, (change + MERGE, "merge", 0))
    return best


STEPS = {role: _steps(role) for role in range(4)}
#: What it costs to end in a state: user and assistant turns may end a conversation; after a system turn an empty user turn follows.
END = {START: FAR, SYSTEM: INSERT, USER: 0, ASSISTANT: 0}


def advance(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Least costs by state after a turn, and the state before it on the way there. Ties go to the lower state before."""
    out, back = [FAR] * 4, [-1] * 4
    for (s, q), (cost, _, _) in sorted(STEPS[role].items()):
        if costs[s] + cost < out[q]:
            out[q], back[q] = costs[s] + cost, s
    return out, back


def stretch_matrix(roles: list[int]) -> list[list[int]]:
    """Least costs from each state to each over a stretch of turns."""
    rows = []
    for s in range(4):
        costs = [FAR] * 4
        costs[s] = 0
        for r in roles:
            costs = [min(c, FAR) for c in advance(costs, r)[0]]
        rows.append(costs)
    return rows


def repair(roles: list[int], first: int = START, last: int | None = None) -> list[tuple[int, Step]]:
    """For each turn the state after it and the step taken, over the cheapest way from ``first`` to ``last`` (or to any end)."""
    costs, backs = [FAR] * 4, []
    costs[first] = 0
    for r in roles:
        costs, back = advance(costs, r)
        backs.append(back)
    state = min(range(4), key=lambda s: (costs[s] + END[s], s)) if last is None else last
    way = []
    for r, back in zip(reversed(roles), reversed(backs), strict=True):
        before = back[state]
        way.append((state, STEPS[r][before, state]))
        state = before
    return way[::-1]


COLUMNS = "conv_id long, turn long, role string, text string"
RESULT = "conv_id long, position long, part int, turn long, role string, action string, text string, rendered string, cost int"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, [(turn, role, text)]) of a partition whose rows come in order."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for conv, turns in groupby(rows, key=lambda r: r[0]):
        yield conv, [r[1:] for r in turns]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, edges = TaskContext.get().partitionId(), []
    for conv, turns in _stretches(batches):
        roles = [role_state(r) for _, r, _ in turns]
        edges = [*edges[:1], (part, conv, roles)]
    names = ["part", "place", "conv_id", "n", "matrix"]
    if edges:
        ordered = [(p, k, c, len(roles), [x for line in stretch_matrix(roles) for x in line]) for k, (p, c, roles) in enumerate(edges)]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*ordered, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=names)


def _join(reports: list) -> dict[tuple[int, int], tuple[int, int, int | None, bool]]:
    """By (partition, which edge): state before, turns before, state after (None: free), whether the conversation ends there."""
    out, rows = {}, sorted(reports, key=lambda r: (r["part"], r["place"]))
    runs = [list(g) for _, g in groupby(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"]))]
    for run in runs:
        costs, backs = [0, FAR, FAR, FAR], []
        for r in run:
            m = r["matrix"]
            ways = [[(costs[s] + m[4 * s + t], s) for s in range(4)] for t in range(4)]
            backs.append([min(w)[1] for w in ways])
            costs = [min(min(w)[0], FAR) for w in ways]
        state = min(range(4), key=lambda s: (costs[s] + END[s], s))
        before, found = sum(r["n"] for r in run), []
        for k in range(len(run) - 1, -1, -1):
            r, entry = run[k], backs[k][state]
            before -= r["n"]
            found.append(((r["part"], r["place"]), (entry, before, state, k == len(run) - 1)))
            state = entry
        out |= dict(found)
    return out


def _render(conv, turns: list[tuple], entry: int, before: int, last: int | None, ends: bool) -> Iterator[tuple]:
    way = repair([role_state(r) for _, r, _ in turns], entry, last)
    closed, state = entry == START, entry
    for k, ((turn, _, text), (state, (cost, action, inserted))) in enumerate(zip(turns, way, strict=True)):
        name, text = ROLES[state - 1], text or ""
        if inserted:
            empty = ROLES[inserted - 1]
            yield conv, before + k, 0, None, empty, "insert", "", ("" if closed else CLOSE) + OPEN.format(role=empty), INSERT
            cost, closed = cost - INSERT, False
        lead = JOIN if action == "merge" else ("" if closed else CLOSE) + OPEN.format(role=name)
        final = CLOSE if ends and k == len(turns) - 1 else ""
        closed = False
        yield conv, before + k, 1, turn, name, action, text, lead + text + final, cost
    if ends and state == SYSTEM:
        yield conv, before + len(turns) - 1, 2, None, "user", "insert", "", OPEN.format(role="user") + CLOSE, INSERT


def repair_roles(conversations: DataFrame) -> DataFrame:
    """The operator: rows (conv_id, position, part, turn, role, action, text, rendered, cost).

    A row for each given turn, by ``position`` in its conversation, and one for each empty turn put in (part 0 before
    its turn, part 2 at the end; ``turn`` is null). ``action`` is keep, relabel, merge or insert. ``rendered`` is the
    row's share of the rendered conversation: joined in the order of position and part they give the whole.

    Turns are ordered by turn, role and text, nulls first, so repeated rows stand together and merge. Null roles and
    role names that aren't known are relabelled cheaply; null text is empty. Rows with a null conv_id are one
    conversation. An empty table gives no rows; further columns are ignored.
    """
    spark, keys = conversations.sparkSession, ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(tasks_for(spark, rows), *[F.col(c).asc_nulls_first() for c in keys])
    ordered = cut(dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys]))
    # two rows a partition at most
    edges = _join(ordered.mapInArrow(_report, "part int, place int, conv_id long, n long, matrix array<long>").collect())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, stretches, number = TaskContext.get().partitionId(), [], _stretches(batches), 0
        current = next(stretches, None)
        while current is not None:
            following = next(stretches, None)
            place = 0 if number == 0 else 1 if following is None else None
            entry, before, last, ends = edges[part, place] if place is not None else (START, 0, None, True)
            out += _render(*current, entry, before, last, ends)
            current, number = following, number + 1
            if len(out) >= 2000 or current is None:
                yield _as_batch(out)
                out = []

    return ordered.mapInArrow(finish, RESULT)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def rendered_conversations(repaired: DataFrame) -> DataFrame:
    """(conv_id, rendered) for conversations that are known to fit in a row each."""
    parts = F.array_sort(F.collect_list(F.struct("position", "part", "rendered")))
    return repaired.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"))

