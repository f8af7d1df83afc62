"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, with an
assistant turn at the end.  Reading the turns in order, an automaton whose state is the role of the last
turn pays for each of them: nothing to keep it, ``MERGE`` to join it to the turn before of the same role,
``RELABEL`` to give it another role (``NAME`` if its role is unknown), ``INSERT`` for each empty turn put
before it, and the same for empty turns at the end.  The cheapest way is a shortest path.

A conversation of any length is cut into segments of bounded size.  Each yields the matrix of least costs
from every state to every state; matrices of one conversation are combined associatively, level by level,
with at most ``FAN`` of them in one group; then states are handed down the levels and each segment traces
its own path back.  No task holds a whole conversation.

The result has one row for each turn, whose ``fragment`` is what it adds to the rendered conversation.

Defined cases: turns are read by turn number, nulls first, ties by role and text; repeated rows are turns
of their own; rows without a conversation id form one conversation; a null text is empty; role names are
trimmed and lower-cased and some other names are known; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import staged, worker_imports

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER_NAMES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "ai": "assistant", "model": "assistant", "gpt": "assistant"}
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, NAME = 2, 3, 4, 1
NEVER = 1 << 40
#: Turns of a segment, matrices combined by one group, and turns sorted by one task.
SEGMENT, FAN, TURNS_PER_TASK = 256, 256, 20_000
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def inserted(state: int, target: int) -> list[int] | None:
    """Fewest empty turns that make ``target`` legal after ``state``."""
    paths, seen = [[state]], {state}
    while paths:
        path = paths.pop(0)
        if target in FOLLOWS[path[-1]]:
            return path[1:]
        for step in FOLLOWS[path[-1]]:
            if step not in seen:
                seen.add(step)
                paths.append([*path, step])
    return None


def _steps() -> tuple[np.ndarray, dict]:
    """Least cost of each given role (3 is unknown) from state to state, and whether it merges."""
    costs, merges = np.full((4, 4, 4), NEVER, np.int64), {}
    for given in range(4):
        for state in range(4):
            for target in (SYSTEM, USER, ASSISTANT):
                name = 0 if given == target - 1 else NAME if given == 3 else RELABEL
                empty = inserted(state, target)
                ways = [(INSERT * len(empty), False)] if empty is not None else []
                if state == target:
                    ways.append((MERGE, True))
                if ways:
                    cost, merged = min(ways)
                    costs[given, state, target], merges[state, target] = name + cost, merged
    return costs, merges


STEP, MERGES = _steps()
END = np.array([NEVER, *[INSERT * (0 if s == ASSISTANT else 1 + len(inserted(s, ASSISTANT))) for s in (SYSTEM, USER, ASSISTANT)]], np.int64)


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = OTHER_NAMES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def combine(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Least costs through both: the matrix product with minimum and sum."""
    return np.minimum((one[:, :, None] + two[None, :, :]).min(1), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for matrix in matrices[1:]:
        out = combine(out, matrix)
    return out


def trace(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States after each matrix on a cheapest path from ``entry`` to ``leave``."""
    costs = [np.full(4, NEVER)]
    costs[0][entry] = 0
    for matrix in matrices:
        costs.append(np.minimum((costs[-1][:, None] + matrix).min(0), NEVER))
    states = [leave]
    for at in range(len(matrices) - 1, 0, -1):
        states.append(int((costs[at] + matrices[at][:, states[-1]]).argmin()))
    return states[::-1]


def repaired_turns(roles: list[int], entry: int, leave: int, last: bool) -> list[tuple[str, str, list[int], list[int]]]:
    """Role, action and empty turns before and after, of each turn of a segment."""
    out, state = [], entry
    states = trace([STEP[r] for r in roles], entry, leave)
    for at, (given, target) in enumerate(zip(roles, states)):
        merged = MERGES[state, target]
        action = ("merge" if merged else "keep") + ("" if given == target - 1 else "+relabel")
        after = [*inserted(target, ASSISTANT), ASSISTANT] if last and at == len(roles) - 1 and target != ASSISTANT else []
        out.append((ROLES[target - 1], action, [] if merged else inserted(state, target), after))
        state = target
    return out


def fragment(text: str, role: str, action: str, before: list[int], after: list[int], opens: bool, last: bool) -> str:
    def empty(states: list[int]) -> str:
        return "".join(OPEN.format(ROLES[s - 1]) + CLOSE for s in states)

    if action.startswith("merge"):
        out = JOIN + text
    else:
        out = ("" if opens else CLOSE) + empty(before) + OPEN.format(role) + text
    return out + (CLOSE + empty(after) if last else "")


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns to segments: runs of one conversation with their cost matrix."""
    part, number, held = TaskContext.get().partitionId(), 0, None

    def made(rows: pd.DataFrame) -> dict:
        nonlocal number
        number += 1
        roles = [role_number(r) for r in rows["role"]]
        return {"conv": rows["conv"].iloc[0], "part": part, "number": number, "turns": rows["turn"].astype(object).where(rows["turn"].notna(), None).tolist(),
                "roles": roles, "texts": rows["text"].fillna("").tolist(), "matrix": product([STEP[r] for r in roles]).ravel().tolist()}

    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        same = (held["conv"] == held["conv"].shift()) | (held["conv"].isna() & held["conv"].shift().isna())
        starts = [0, *(np.flatnonzero(~same.to_numpy()[1:]) + 1).tolist(), len(held)]
        out = []
        for start, end in zip(starts, starts[1:]):
            last = end == len(held)
            while end - start > SEGMENT or (end > start and not last):
                out.append(made(held.iloc[start:min(start + SEGMENT, end)]))
                start = min(start + SEGMENT, end)
        held = held.iloc[start:].reset_index(drop=True)
        if out:
            yield pd.DataFrame(out)
    if held is not None and len(held):
        yield pd.DataFrame([made(held)])


def _matrices(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m, np.int64).reshape(4, 4) for m in rows["matrix"]]


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv, place (order in the conversation), turn, role, action and fragment."""
    spark = turns.sparkSession
    worker_imports(spark)
    kinds = dict(turns.dtypes)
    slim = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                        F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    order = ["conv", "turn", "role", "text"]
    tasks = max(1, -(-slim.count() // TURNS_PER_TASK))
    kind, kind_turn = kinds[conv], kinds[turn]
    shape = f"conv {kind}, part bigint, number bigint, turns array<{kind_turn}>, roles array<int>, texts array<string>, matrix array<bigint>"
    segments = staged(slim.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(_segments, shape), "segments")

    # up the levels: the parts of a conversation, then runs of FAN of them, until one matrix is left
    cells = segments.select("conv", "part", F.col("number").alias("at"), "matrix")
    many = staged(segments.groupBy("conv").count().filter("count > 1").select(F.col("conv").alias("many")), "many")
    levels = [cells.join(many, F.expr("conv <=> many"), "left_semi")]
    width = 1
    while True:
        low = levels[-1]
        group = F.floor(F.col("part") / width).cast("bigint") if len(levels) > 1 else F.col("part")
        high = low.withColumn("above", group).groupBy("conv", "above").applyInPandas(
            lambda rows: pd.DataFrame({"conv": rows["conv"].iloc[:1], "part": rows["above"].iloc[:1],
                                       "matrix": [product(_matrices(rows.sort_values("at"))).ravel().tolist()]}),
            f"conv {kind}, part bigint, matrix array<bigint>")
        levels.append(staged(high.withColumn("at", F.col("part")).select("conv", "part", "at", "matrix"), "level"))
        if levels[-1].groupBy("conv").count().filter("count > 1").isEmpty():
            break
        width = FAN
    # down again: each group is told where it is entered and left
    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        leave = [int((np.asarray(m).reshape(4, 4)[START] + END).argmin()) for m in rows["matrix"]]
        return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "entry": START, "leave": leave, "first": True, "last": True})

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        out = ends(rows)
        out.insert(2, "at", rows["at"])
        return out

    # a conversation of one segment needs no levels
    single = cells.join(many, F.expr("conv <=> many"), "left_anti").mapInPandas(
        lambda batches: map(alone, batches), f"conv {kind}, part bigint, at bigint, entry int, leave int, first boolean, last boolean")

    told_shape = f"conv {kind}, part bigint, entry int, leave int, first boolean, last boolean"
    told = levels[-1].mapInPandas(lambda batches: map(ends, batches), told_shape)
    for number in range(len(levels) - 2, -1, -1):
        low = levels[number]
        group = F.floor(F.col("part") / FAN).cast("bigint") if number else F.col("part")
        joined = low.withColumn("above", group).alias("l").join(
            told.withColumnsRenamed({"conv": "conv_up", "part": "part_up"}), F.expr("conv <=> conv_up and above = part_up")).drop("conv_up", "part_up")

        def hand_down(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            states = trace(_matrices(rows), int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0]))
            size = len(rows)
            return pd.DataFrame({
                "conv": rows["conv"], "part": rows["part"], "at": rows["at"], "entry": [int(rows["entry"].iloc[0]), *states[:-1]], "leave": states,
                "first": [bool(rows["first"].iloc[0])] + [False] * (size - 1), "last": [False] * (size - 1) + [bool(rows["last"].iloc[0])]})

        told = joined.groupBy("conv", "above").applyInPandas(hand_down, f"conv {kind}, part bigint, at bigint, entry int, leave int, first boolean, last boolean")
        told = staged(told if number == 0 else told.drop("at"), "told")

    paths = told.unionByName(single).withColumnsRenamed({"conv": "conv_up", "part": "part_up"})
    whole = segments.join(paths, F.expr("conv <=> conv_up and part = part_up and number = at"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in batch.itertuples(index=False):
                told_turns = repaired_turns(list(s.roles), s.entry, s.leave, s.last)
                for at, (t, body, (name, action, before, after)) in enumerate(zip(s.turns, s.texts, told_turns)):
                    last = s.last and at == len(told_turns) - 1
                    rows.append((s.conv, (s.part << 40) + (s.number << 10) + at, t, name, action, len(before) + len(after),
                                 fragment(body, name, action, before, after, s.first and at == 0, last)))
            yield pd.DataFrame(rows, columns=["conv", "place", "turn", "role", "action", "inserted", "fragment"])

    return whole.mapInPandas(render, f"conv {kind}, place bigint, turn {kind_turn}, role string, action string, inserted int, fragment string").withColumnRenamed("conv", conv)


def render(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One string for each conversation, for conversations that fit one row."""
    pieces = F.array_sort(F.collect_list(F.struct("place", "fragment")))
    return repaired.groupBy(conv).agg(F.concat_ws("", F.transform(pieces, lambda p: p["fragment"])).alias("rendered"))
