"""Traces through a graph whose steps have kinds: reachability under an automaton, the paths and the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Stage

#: (state, kind of edge, next state)
Moves = list[tuple[str, str, str]]


def _next(moves: Moves, state: Column, kind: Column) -> Column:
    """The states that follow, as an array; the automaton may be nondeterministic."""
    table: dict[str, list[str]] = {}
    for a, k, b in moves:
        table.setdefault(f"{a}|{k}", []).append(b)
    known = F.create_map(*[x for key, states in table.items() for x in (F.lit(key), F.array(*[F.lit(s) for s in dict.fromkeys(states)]))])
    return known[F.concat(state, F.lit("|"), kind)]


def constrained_reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, moves: Moves, start: str, *, max_depth: int, until: str | None = None) -> DataFrame:
    """``seed, node, state, depth, parent, parent_state, kind``: what a trace from each seed reaches, and in which state.

    ``edges`` has ``source, target, kind``, ``seeds`` has ``seed``. A trace starts at the seed in ``start``; an edge may
    be taken if the automaton has a move for its kind in the current state. Each (node, state) of a seed is there once, at
    its least depth, with the least parent of that depth; the seed itself at depth 0 without a parent. Steps beyond
    ``max_depth`` are not taken: it is a parameter of the trace. Null ends and kinds lead nowhere.

    With ``until`` a seed that has got to that state goes no further: the rows up to the depth of its first such node are
    there, those beyond are not made. That is what the shortest ways to this state need.

    A fixpoint join over written rounds. The rows are at most seeds by reached nodes by states.
    """
    stage = Stage(spark, "traces")
    steps = stage.save(edges.select("source", "target", "kind").where("source IS NOT NULL AND target IS NOT NULL AND kind IS NOT NULL").distinct())
    node = seeds.schema["seed"].dataType
    first = seeds.select("seed").where("seed IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    new = stage.save(first.select("seed", F.col("seed").alias("node"), F.lit(start).alias("state"), F.lit(0).alias("depth"), F.lit(None).cast(node).alias("parent"), none.alias("parent_state"), none.alias("kind")))
    known, rounds = new.select("seed", "node", "state"), [new]
    for depth in range(1, max_depth + 1):
        if until is not None:
            arrived = new.where(F.col("state") == until).select("seed").distinct()
            new, known = (x.join(arrived, "seed", "left_anti") for x in (new, known))
        at = new.select("seed", F.col("node").alias("parent"), F.col("state").alias("parent_state"))
        met = at.join(steps, F.col("parent") == F.col("source")).select("seed", F.col("target").alias("node"), F.explode(_next(moves, F.col("parent_state"), F.col("kind"))).alias("state"), "parent", "parent_state", "kind")
        best = met.join(known, ["seed", "node", "state"], "left_anti").groupBy("seed", "node", "state").agg(F.min(F.struct("parent", "parent_state", "kind")).alias("by"))
        new = stage.save(best.select("seed", "node", "state", F.lit(depth).alias("depth"), "by.parent", "by.parent_state", "by.kind"))
        if new.isEmpty():
            break
        rounds.append(new)
        known = known.unionByName(new.select("seed", "node", "state"))
    every = rounds[0]
    for one in rounds[1:]:
        every = every.unionByName(one)
    return every


def trace_paths(spark: SparkSession, reach: DataFrame, state: str) -> DataFrame:
    """``seed, path, states``: for each seed that gets to ``state`` the way to the node that it reaches first there.

    Of several at the same depth the least node is meant. The way is put together backwards by the parents, one join a step.
    """
    stage = Stage(spark, "trace-paths")
    kept = stage.save(reach.select("seed", "node", "state", "depth", "parent", "parent_state"))
    ends = kept.where(F.col("state") == state).groupBy("seed").agg(F.min(F.struct("depth", "node")).alias("e"))
    at = stage.save(ends.select("seed", F.col("e.node").alias("node"), F.lit(state).alias("state"), F.array("e.node").alias("path"), F.array(F.lit(state)).alias("states")))
    done = []
    while not at.isEmpty():
        up = at.join(kept.drop("depth"), ["seed", "node", "state"])
        done.append(up.where("parent IS NULL").select("seed", "path", "states"))
        at = stage.save(up.where("parent IS NOT NULL").select("seed", F.col("parent").alias("node"), F.col("parent_state").alias("state"), F.concat(F.array("parent"), "path").alias("path"), F.concat(F.array("parent_state"), "states").alias("states")))
    every = done[0] if done else at.select("seed", "path", "states")
    for one in done[1:]:
        every = every.unionByName(one)
    return every


def trace_summary(reach: DataFrame, states: list[str]) -> DataFrame:
    """``seed, n_steps, depth, fan_out, gaps`` and for each state the number of its nodes.

    ``fan_out`` is the greatest number of steps that one (node, state) leads on to; ``gaps`` are the states that the
    seed never gets to, in the order given.
    """
    wide = reach.groupBy("seed").agg(F.count("*").alias("n_steps"), F.max("depth").alias("depth"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states])
    fan = reach.where("parent IS NOT NULL").groupBy("seed", "parent", "parent_state").count().groupBy("seed").agg(F.max("count").alias("fan_out"))
    gaps = F.array_compact(F.array(*[F.when(F.col(f"n_{s}") == 0, s) for s in states]))
    return wide.join(fan, "seed", "left").fillna(0, ["fan_out"]).withColumn("gaps", gaps)
