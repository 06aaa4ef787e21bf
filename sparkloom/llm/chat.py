"""Operator 4: minimum-cost repair of the roles in conversations, then rendering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import placed
from .store import Stage

ROLES = ("system", "user", "assistant", "tool")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "function": "tool", "developer": "system"}
#: The legal-turn automaton: a state is the role of the last turn, "start" before any.
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
STATES = ("start", *ROLES)
FINAL = "assistant"
#: Costs: appending a turn to the one before, giving it another role, inserting an empty turn.
MERGE, RELABEL, INSERT = 1, 3, 2
#: Turns of one conversation that meet in a task.
SEGMENT = 1024
BIG = 1 << 40


def _insertions() -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, ...]]]:
    """Fewest empty turns from each state so that a turn of each role may follow, and which ones."""
    cost, path = np.full((5, 5), BIG), {}
    for s, state in enumerate(STATES):
        frontier = [(state, ())]
        seen = {state}
        while frontier:
            grown = []
            for at, via in frontier:
                for role in NEXT[at]:
                    r = STATES.index(role)
                    if cost[s, r] == BIG:
                        cost[s, r], path[s, r] = INSERT * len(via), via
                    if role not in seen:
                        seen.add(role)
                        grown.append((role, (*via, role)))
            frontier = grown
    return cost, path


_REACH, _PATH = _insertions()


def _steps() -> tuple[np.ndarray, list]:
    """For each input role (4: unknown) the cheapest way from state to state, as a matrix and as actions.

    Ties go to a merge before a new turn; the reached role is the column, so relabels are compared by the caller.
    """
    cost = np.full((5, 5, 5), BIG)
    action = [[[None] * 5 for _ in range(5)] for _ in range(5)]
    for role in range(5):
        for s in range(5):
            for q in range(1, 5):
                relabel = 0 if role == 4 or q == role + 1 else RELABEL
                if s == q:
                    cost[role, s, q], action[role][s][q] = MERGE + relabel, ("merge", ())
                if _REACH[s, q] + relabel < cost[role, s, q]:
                    cost[role, s, q], action[role][s][q] = _REACH[s, q] + relabel, ("turn", _PATH[s, q])
    return cost, action


_COST, _ACTION = _steps()
_END = np.array([0 if s == FINAL else (_REACH[i, STATES.index(FINAL)] + INSERT) for i, s in enumerate(STATES)])
_END_PATH = [() if s == FINAL else (*_PATH[i, STATES.index(FINAL)], FINAL) for i, s in enumerate(STATES)]


def _by_length(roles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of turns as rows of one table, longest first: their order, the table, and how many reach each place."""
    lengths = np.array([len(r) for r in roles])
    order = np.argsort(-lengths, kind="stable")
    table = np.zeros((len(roles), int(lengths.max(initial=0))), np.int64)
    for i, k in enumerate(order):
        table[i, : lengths[k]] = roles[k]
    return order, table, (lengths[order][:, None] > np.arange(table.shape[1])).sum(axis=0)


def segment_matrices(roles: list[np.ndarray]) -> np.ndarray:
    """Least cost through each run of turns from each state to each: products of step matrices in (min, +), place by place."""
    order, table, reach = _by_length(roles)
    total = np.repeat(np.where(np.eye(5, dtype=bool), 0, BIG)[None], len(roles), axis=0)
    for p, n in enumerate(reach):
        total[:n] = (total[:n, :, :, None] + _COST[table[:n, p]][:, None, :, :]).min(axis=2)
    out = np.empty_like(total)
    out[order] = np.minimum(total, BIG)
    return out


def repairs(roles: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each run of turns between two states the states before and after each turn on the cheapest way."""
    order, table, reach = _by_length(roles)
    best, back = np.full((len(roles), 5), BIG), []
    best[np.arange(len(roles)), start[order]] = 0
    for p, n in enumerate(reach):
        whole = best[:n, :, None] + _COST[table[:n, p]]
        back.append(whole.argmin(axis=1))
        best[:n] = whole.min(axis=1)
    came, reached, at = np.zeros_like(table), np.zeros_like(table), end[order].copy()
    for p in range(len(reach) - 1, -1, -1):
        n = reach[p]
        reached[:n, p] = at[:n]
        at[:n] = back[p][np.arange(n), at[:n]]
        came[:n, p] = at[:n]
    place = np.empty(len(roles), np.int64)
    place[order] = np.arange(len(roles))
    return [(came[place[k], : len(r)], reached[place[k], : len(r)]) for k, r in enumerate(roles)]


def _grouped(batches, keys: list[str]):
    """Whole groups from batches sorted by the keys (None is a key value like others)."""
    held, last = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        codes = list(zip(*[pdf[k].tolist() for k in keys], strict=True))
        codes = [tuple(None if v is None or v != v else v for v in c) for c in codes]
        starts = [i for i in range(len(codes)) if i == 0 or codes[i] != codes[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
            if held and codes[a] != last:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b])
            last = codes[a]
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def _some(groups, most: int):
    """Lists of up to ``most`` groups."""
    held = []
    for group in groups:
        held.append(group)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _matrices(batches):
    for groups in _some(_grouped(batches, ["segment", "conv"]), 4096):
        costs = segment_matrices([pdf["role"].to_numpy() for _, pdf in groups])
        yield _frame([(conv, segment, len(pdf), c.ravel().tolist()) for ((segment, conv), pdf), c in zip(groups, costs, strict=True)])


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "segment", "turns", "costs"]).astype({"conv": "Int64", "segment": "int64", "turns": "int64"})


def _routes(batches):
    """The states between the segments of a conversation on its cheapest way, from the segments' matrices."""
    out = []
    for (conv,), pdf in _grouped(batches, ["conv"]):
        best, back = np.full(5, BIG), []
        best[0] = 0
        for costs in pdf["costs"]:
            whole = best[:, None] + np.array(costs).reshape(5, 5)
            back.append(whole.argmin(axis=0))
            best = whole.min(axis=0)
        end = int((best + _END).argmin())
        cost, states = int((best + _END)[end]), [end]
        for came in reversed(back):
            states.append(int(came[states[-1]]))
        states.reverse()
        n = len(back)
        for i, segment in enumerate(pdf["segment"].tolist()):
            out.append((conv, segment, states[i], states[i + 1], i == n - 1, cost))
    yield pd.DataFrame(out, columns=["conv", "segment", "start", "end", "last", "cost"]).astype({"conv": "Int64", "segment": "int64", "start": "int32", "end": "int32", "last": "bool", "cost": "int64"})


def _render(batches):
    for groups in _some(_grouped(batches, ["segment", "conv"]), 2048):
        start, end = (np.array([pdf[c].iloc[0] for _, pdf in groups], np.int64) for c in ("start", "end"))
        ways = repairs([pdf["role"].to_numpy() for _, pdf in groups], start, end)
        yield _rendered([_turns(segment, conv, pdf, *way) for ((segment, conv), pdf), way in zip(groups, ways, strict=True)])


def _turns(segment, conv, pdf: pd.DataFrame, came: np.ndarray, reached: np.ndarray) -> tuple:
    """One segment's turns after the repair."""
    merged = relabelled = inserted = 0
    turns: list[list] = []
    for role, text, s, q in zip(pdf["role"].tolist(), pdf["text"].tolist(), came.tolist(), reached.tolist(), strict=True):
        action, before = _ACTION[role][s][q]
        text = "" if text is None else text
        relabelled += int(role != 4 and role + 1 != q)
        inserted += len(before)
        turns += [[r, "", False] for r in before]
        if action == "merge":
            merged += 1
            if turns:
                turns[-1][1] += "\n" + text
            else:  # goes on with the turn that the segment before left
                turns.append([STATES[q], text, True])
        else:
            turns.append([STATES[q], text, False])
    if pdf["last"].iloc[0]:
        tail = _END_PATH[int(pdf["end"].iloc[0])]
        inserted += len(tail)
        turns += [[r, "", False] for r in tail]
    return conv, segment, len(pdf), [t[0] for t in turns], [t[1] for t in turns], bool(turns and turns[0][2]), merged, relabelled, inserted, int(pdf["cost"].iloc[0])


def _rendered(rows) -> pd.DataFrame:
    names = ["conv", "segment", "turns_in", "roles", "texts", "continues", "merged", "relabelled", "inserted", "cost"]
    return pd.DataFrame(rows, columns=names).astype({"conv": "Int64", "segment": "int64", "turns_in": "int64", "continues": "bool", "merged": "int64", "relabelled": "int64", "inserted": "int64", "cost": "int64"})


def repair_conversations(spark: SparkSession, df: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", segment: int = SEGMENT) -> DataFrame:
    """One row per conversation segment: ``<conv>, segment, last_segment, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, roles, rendered``.

    Turns in the order (turn, role, text), nulls first, walk a legal-turn automaton: system once at the start, user and
    assistant in turn, tool after assistant, an assistant turn at the end. The cheapest mix of merging a turn into the
    one before (MERGE), relabelling it (RELABEL) and inserting empty turns (INSERT) is found by dynamic programming;
    ``cost`` is the whole conversation's. Roles are trimmed and lower-cased, ALIASES apply, an unknown or null role fits
    any turn at no cost. Null texts are empty, null conversation ids make one conversation, null turn numbers come
    first, repeated turns are turns, an empty table gives an empty result; other columns are not looked at. ``<|`` in a
    text is rendered as ``<\\|``, so no text can forge a turn.

    A conversation is cut into segments by the places of its turns in this order, ``segment`` to each, whatever their
    numbers; the cost matrices of the segments multiply in (min, +), so no task holds the turns of a whole conversation,
    only one matrix a segment. Nearly every conversation has one segment and so one row; ``rendered`` of the segments in
    order, concatenated, is the conversation. The text of a very long turn is in one task.
    """
    stage = Stage(spark, "chat")
    role = F.lower(F.trim(F.col(role_col).cast("string")))
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), role), role)
    number = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), role) - 1, F.lit(-1)).cast("int")
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(number < 0, 4).otherwise(number).alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    turns = placed(stage, turns, ["conv"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc_nulls_first("text")])
    turns = stage.save(turns.withColumn("segment", F.floor((F.col("place") - 1) / segment)))
    order = ["segment", "conv", "place"]
    dealt = turns.repartition("segment", "conv").sortWithinPartitions(*order)
    matrices = stage.save(dealt.select("conv", "segment", "role").mapInPandas(_matrices, "conv long, segment long, turns long, costs array<long>"))
    routes = matrices.select("conv", "segment", "costs").repartition("conv").sortWithinPartitions("conv", "segment")
    routes = stage.save(routes.mapInPandas(_routes, "conv long, segment long, start int, end int, last boolean, cost long"))
    routed = turns.alias("t").join(routes.alias("r"), F.col("t.conv").eqNullSafe(F.col("r.conv")) & (F.col("t.segment") == F.col("r.segment"))).select(
        "t.conv", "t.segment", "t.place", "t.role", "t.text", "start", "end", "last", "cost"
    )
    rendered = routed.repartition("segment", "conv").sortWithinPartitions(*order).mapInPandas(
        _render, "conv long, segment long, turns_in long, roles array<string>, texts array<string>, continues boolean, merged long, relabelled long, inserted long, cost long"
    )
    first = F.col("continues")
    pieces = F.transform(
        F.arrays_zip("roles", "texts"),
        lambda x, i: F.concat(
            F.when(first & (i == 0), F.lit("\n")).otherwise(F.concat(F.when((i > 0) | (F.col("segment") > F.col("low")), F.lit("\n<|end|>\n")).otherwise(""), F.lit("<|"), x["roles"], F.lit("|>\n"))),
            F.replace(x["texts"], F.lit("<|"), F.lit("<\\|")),
        ),
    )
    low = matrices.groupBy("conv").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    out = rendered.alias("x").join(low.alias("y"), F.col("x.conv").eqNullSafe(F.col("y.conv"))).select("x.*", "low", "high")
    body = F.concat(F.array_join(pieces, ""), F.when(F.col("segment") == F.col("high"), F.lit("\n<|end|>\n")).otherwise(""))
    return out.select(
        F.col("conv").alias(conv_col),
        "segment",
        (F.col("segment") == F.col("high")).alias("last_segment"),
        F.col("turns_in").alias("n_turns"),
        (F.size("roles") - first.cast("int")).cast("long").alias("n_out"),
        F.col("merged").alias("n_merged"),
        F.col("relabelled").alias("n_relabelled"),
        F.col("inserted").alias("n_inserted"),
        "cost",
        "roles",
        body.alias("rendered"),
    )
