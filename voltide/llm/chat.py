"""Minimum-cost repair of chat roles, then rendering.

Legal conversations: at most one system turn, first; then user and assistant in
turn, user first, assistant last. The automaton's state is the role of the turn
now open. Each input turn may keep its role or be relabelled, and is then
merged into an open turn of that role, placed after it where that is legal, or
placed after inserted empty turns. The cheapest sequence wins; ties go to the
earlier of keep, merge, relabel and insert, then to the earlier role.

Costs: merge 1, relabel 2 (an unknown role: 1), each inserted turn 3.

Costs add up along a path, so a run of turns is a small matrix of cheapest costs
from state to state, and matrices of runs combine in (min, +). Turns are dealt
out by conversation and turn in ranges and cut into runs of bounded length;
only the matrices of conversations of several runs meet, and each run is then
repaired on its own between the states found. So one endless conversation
spreads over many tasks.

One row per input turn and per inserted turn. ``rendered`` closes the turn
before where a new one opens, so the conversation's text is the concatenation
of its rows by ``seq``.

Defined results: turns order by number (null first), then by role and text;
repeated rows are turns of their own; a null conv_id is one conversation; a null
text is empty; a null role is unknown; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import c, map_frames
from voltide.session import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Other names of the three roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
FAR = 1 << 40
ACTIONS = ("keep", "merge", "relabel", "relabel_merge", "insert")
#: Turns that are inserted between a state and a role; None where that is illegal.
BRIDGE = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, SYSTEM): None, (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: What is inserted at the end.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
TURNS = "conv_id long, turn long, role string, text string, part long, run long, pos long, n_run long"
OUT = "conv_id long, seq long, turn long, role_in string, role_out string, action string, cost long, rendered string"


def role_of(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), START)


def options(role: int) -> list[list[tuple[int, int, int, int]]]:
    """For each state, (cost, preference, target role, merged) of a turn."""
    out: list[list[tuple[int, int, int, int]]] = []
    for state in range(4):
        found = []
        for target in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if target == role else UNKNOWN if role == START else RELABEL
            if state == target:
                found.append((relabel + MERGE, 3 if relabel else 1, target, 1))
            if (bridge := BRIDGE[state, target]) is not None:
                found.append((relabel + INSERT * len(bridge), (4 if bridge else 2 if relabel else 0), target, 0))
        out.append(found)
    return out


_OPTIONS = {role: options(role) for role in range(4)}


def run_matrix(roles: list[int]) -> np.ndarray:
    """Cheapest costs from each state to each state over a run of turns."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    steps = {}
    for role in set(roles):
        s = np.full((4, 4), FAR, np.int64)
        for state in range(4):
            for cost, _, target, _ in _OPTIONS[role][state]:
                s[state, target] = min(s[state, target], cost)
        steps[role] = s
    for role in roles:
        m = np.minimum((m[:, :, None] + steps[role][None]).min(axis=1), FAR)
    return m


def repair_run(roles: list[int], first: int, last: int | None) -> list[tuple[int, int, tuple[int, ...]]]:
    """(target role, merged, inserted before) of each turn, from state
    ``first`` to state ``last`` (None: the cheapest to close)."""
    best = [FAR] * 4
    best[first] = 0
    back: list[list[tuple[int, int, int]]] = []
    for role in roles:
        now, trace = [(FAR, 9, 9)] * 4, [(0, 0, 0)] * 4
        for state in range(4):
            if best[state] < FAR:
                for cost, rank, target, merged in _OPTIONS[role][state]:
                    key = (best[state] + cost, rank, state)
                    if key < now[target]:
                        now[target], trace[target] = key, (state, merged, target)
        best = [k[0] for k in now]
        back.append(trace)
    if last is None:
        last = min(range(4), key=lambda s: (best[s] + INSERT * len(CLOSE[s]), s))
    out, state = [], last
    for trace in reversed(back):
        before, merged, target = trace[state]
        out.append((target, merged, () if merged else BRIDGE[before, target]))
        state = before
    return out[::-1]


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The states between the runs of one conversation, START first."""
    best, costs = np.array([0, FAR, FAR, FAR], np.int64), []
    for m in matrices:
        costs.append(best)
        best = np.minimum((best[:, None] + m).min(axis=0), FAR)
    state = min(range(4), key=lambda s: (int(best[s]) + INSERT * len(CLOSE[s]), s))
    out = [state]
    for m, before in zip(reversed(matrices), reversed(costs), strict=True):
        state = int(np.argmin(before + m[:, state]))
        out.append(state)
    return out[::-1]


def rows_of(turns: list[tuple], first: int, last: int | None, is_last: bool, base: int) -> list[tuple]:
    """Output rows of a run; turns are (turn, role, text)."""
    open_, out, seq = first, [], base

    def add(turn, name, target, action, cost, text):
        nonlocal open_, seq
        merged = action in ("merge", "relabel_merge")
        head = "\n" if merged else f"{'<|end|>' + chr(10) if open_ != START else ''}<|{NAMES[target]}|>\n"
        out.append([turn, seq, name, NAMES[target], action, cost, head + (text or "")])
        open_, seq = target, seq + 1

    plan = repair_run([role_of(t[1]) for t in turns], first, last)
    for (turn, name, text), (target, merged, bridge) in zip(turns, plan, strict=True):
        for extra in bridge:
            add(None, None, extra, "insert", INSERT, "")
        role = role_of(name)
        relabel = 0 if role == target else UNKNOWN if role == START else RELABEL
        action = ("relabel_merge" if relabel else "merge") if merged else "relabel" if relabel else "keep"
        add(turn, name, target, action, relabel + MERGE * merged, text)
    if is_last:
        for extra in CLOSE[open_]:
            add(None, None, extra, "insert", INSERT, "")
        out[-1][-1] += "<|end|>\n"
    return out


def ordered_runs(turns: DataFrame, most: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns in ranges of (conversation, turn), cut into runs of one
    conversation and at most ``most`` turns."""
    spark = turns.sparkSession
    rows = turns.select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).cast("long").alias("turn"), c(role_col).cast("string").alias("role"), c(text_col).cast("string").alias("text"))
    # The last key parts rows that agree in all else, so that no range must hold them all.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", "text", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, run, pos, conv, started = TaskContext.get().partitionId(), -1, 0, None, False
        for b in batches:
            runs, places = [], []
            for x in b["conv_id"].astype("Int64"):
                x = None if x is pd.NA else int(x)
                if not started or x != conv or pos + 1 >= most:
                    run, pos, conv, started = run + 1, 0, x, True
                else:
                    pos += 1
                runs.append(run)
                places.append(pos)
            out = b[["conv_id", "turn", "role", "text"]].copy()
            out["conv_id"], out["turn"] = out["conv_id"].astype("Int64"), out["turn"].astype("Int64")
            yield out.assign(part=part, run=runs, pos=places, n_run=0)

    return map_frames(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys), run, TURNS)


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = 512) -> DataFrame:
    """Repaired and rendered turns; see the module's text."""
    scratch = Scratch(turns.sparkSession)
    rows = scratch.table(ordered_runs(turns, most, conv_col, turn_col, role_col, text_col).drop("n_run"), "runs")
    key = ["conv_id", "part", "run"]
    null_safe = lambda a, b: F.col(f"{a}").eqNullSafe(F.col(f"{b}"))
    several = rows.where("pos = 0").groupBy("conv_id").agg(F.count("*").alias("runs")).where("runs > 1").select(F.col("conv_id").alias("long_conv"))
    several = scratch.table(several, "several")
    long_rows = rows.join(several, null_safe("conv_id", "long_conv"), "left_semi").select(*key, "pos", "role")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [run_matrix([role_of(r["role"]) for r in sorted(rs, key=lambda r: r["pos"])]).ravel().tolist() for rs in b["roles"]]
            yield b[key].assign(costs=found, conv_id=b["conv_id"].astype("Int64"))

    packed = long_rows.groupBy(*key).agg(F.collect_list(F.struct("pos", "role")).alias("roles"))
    packed = map_frames(packed, matrices, "conv_id long, part long, run long, costs array<long>")
    # One small matrix for each 512 turns: this is all that a conversation gathers.
    chains = packed.groupBy("conv_id").agg(F.collect_list(F.struct("part", "run", "costs")).alias("chain"))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for conv, chain in zip(b["conv_id"].astype("Int64"), b["chain"], strict=True):
                chain = sorted(chain, key=lambda x: (x["part"], x["run"]))
                at = boundary_states([np.array(x["costs"], np.int64).reshape(4, 4) for x in chain])
                n = len(chain)
                yield pd.DataFrame({"s_conv": pd.array([conv] * n, "Int64"), "s_part": [x["part"] for x in chain], "s_run": [x["run"] for x in chain], "first": at[:-1], "last": at[1:], "nth": range(n), "is_last": [i + 1 == n for i in range(n)]})

    between = scratch.table(map_frames(chains, states, "s_conv long, s_part long, s_run long, first int, last int, nth long, is_last boolean"), "states")
    whole = rows.groupBy(*key).agg(F.collect_list(F.struct("pos", "turn", "role", "text")).alias("turns"))
    placed = whole.join(between, null_safe("conv_id", "s_conv") & (F.col("part") == F.col("s_part")) & (F.col("run") == F.col("s_run")), "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, turns_, first, last, nth, is_last in zip(b["conv_id"].astype("Int64"), b["turns"], b["first"], b["last"], b["nth"], b["is_last"], strict=True):
                alone = pd.isna(first)
                listed = [(None if pd.isna(t["turn"]) else int(t["turn"]), t["role"], t["text"]) for t in sorted(turns_, key=lambda t: t["pos"])]
                got = rows_of(listed, START if alone else int(first), None if alone or is_last else int(last), alone or bool(is_last), 0 if alone else int(nth) << 32)
                out += [(conv, r[1], r[0], *r[2:]) for r in got]
            f = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")], dtype=object)
            for k in ("conv_id", "seq", "turn", "cost"):
                f[k] = f[k].astype("Int64")
            yield f

    return map_frames(placed.select("conv_id", "turns", "first", "last", "nth", "is_last"), finish, OUT)
