"""Traces, condensed graphs and cycles of components against searches over random graphs."""

import random
from collections import deque

from sparkloom.operators import condensation, graph, traces


def searched(edges, seeds, moves, start, most):
    """{(seed, node, state): (depth, parent, parent state, kind)}"""
    out = {}
    for seed in seeds:
        out[seed, seed, start] = (0, None, None, None)
        layer = [(seed, start)]
        for depth in range(1, most + 1):
            best = {}
            for node, state in layer:
                for a, b, kind in edges:
                    for s, k, n in moves:
                        if a == node and s == state and k == kind and (seed, b, n) not in out:
                            best[b, n] = min(best.get((b, n), (node, state, kind)), (node, state, kind))
            for (b, n), by in best.items():
                out[seed, b, n] = (depth, *by)
            layer = list(best)
    return out


MOVES = [("f", "x", "f"), ("f", "y", "b"), ("b", "x", "b"), ("b", "z", "r"), ("f", "z", "r"), ("f", "x", "b")]


def test_traces_of_random_graphs(spark):
    rng = random.Random(5)
    for n in (4, 8):
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice("xyzw")) for _ in range(3 * n)]
        df = spark.createDataFrame([*edges, (None, 1, "x"), (1, None, "x"), (1, 2, None)], "source long, target long, kind string")
        seeds = spark.createDataFrame([(i,) for i in range(n)] + [(None,), (0,)], "seed long")
        reach = traces.constrained_reach(spark, df, seeds, MOVES, "f", max_depth=4)
        expected = searched(edges, range(n), MOVES, "f", 4)
        assert {(r.seed, r.node, r.state): (r.depth, r.parent, r.parent_state, r.kind) for r in reach.collect()} == expected
        paths = {r.seed: (r.path, r.states) for r in traces.trace_paths(spark, reach, "r").collect()}
        ends = {}
        for (seed, node, state), by in expected.items():
            if state == "r":
                ends[seed] = min(ends.get(seed, (by[0], node)), (by[0], node))
        assert set(paths) == set(ends)
        for seed, (path, states) in paths.items():
            assert (len(path) - 1, path[-1]) == ends[seed] and path[0] == seed and states[0] == "f" and states[-1] == "r"
            assert all(any((a, b, k) in edges and (s, k, t) in MOVES for k in "xyz") for a, b, s, t in zip(path, path[1:], states, states[1:], strict=False))
        for r in traces.trace_summary(reach, ["f", "b", "r"]).collect():
            own = [(k, v) for k, v in expected.items() if k[0] == r.seed]
            assert r.n_steps == len(own) and r.gaps == [s for s in "fbr" if not any(k[2] == s for k, _ in own)]
            fans = [(v[1], v[2]) for _, v in own if v[1] is not None]
            assert r.fan_out == max((fans.count(x) for x in fans), default=0)


def test_traces_that_have_arrived_go_no_further(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(9), rng.randrange(9), rng.choice("xyzw")) for _ in range(27)]
    df = spark.createDataFrame(edges, "source long, target long, kind string")
    seeds = spark.createDataFrame([(i,) for i in range(9)], "seed long")
    expected = searched(edges, range(9), MOVES, "f", 4)
    first = {}
    for (seed, _, state), by in expected.items():
        if state == "r":
            first[seed] = min(first.get(seed, 9), by[0])
    reach = traces.constrained_reach(spark, df, seeds, MOVES, "f", max_depth=4, until="r")
    got = {(r.seed, r.node, r.state): (r.depth, r.parent, r.parent_state, r.kind) for r in reach.collect()}
    assert got == {k: v for k, v in expected.items() if v[0] <= first.get(k[0], 9)} and len(got) < len(expected)
    ways = lambda x: sorted(tuple(r) for r in traces.trace_paths(spark, x, "r").collect())
    assert ways(reach) == ways(traces.constrained_reach(spark, df, seeds, MOVES, "f", max_depth=4))


def test_condensed_random_graphs(spark):
    rng = random.Random(8)
    for n in (6, 14):
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(9)) for _ in range(int(1.6 * n))]
        df = spark.createDataFrame([*edges, (None, 1, 1)], "a long, b long, w long")
        c = graph.strong_components(spark, df.where("a is not null"), "a", "b")
        of = {r.node: r.component for r in c.collect()}
        dag = condensation.condense(df, c, "a", "b", "w")
        expected = {}
        for a, b, w in edges:
            x, y = of.get(a, a), of.get(b, b)
            if x != y:
                k, least = expected.get((x, y), (0, 99))
                expected[x, y] = (k + 1, min(least, w))
        assert {(r.source, r.target): (r.n_edges, r.least) for r in dag.collect()} == expected
        nodes = {of.get(i, i) for i in range(n)}
        level = {}

        def deep(x):
            level.setdefault(x, max((1 + deep(a) for a, b in expected if b == x), default=0))  # noqa: B023
            return level[x]  # noqa: B023

        got = condensation.levels(spark, spark.createDataFrame([(x,) for x in nodes], "node long"), dag.select("source", "target")).collect()
        assert {r.node: r.level for r in got} == {x: deep(x) for x in nodes}
        cycles = {r.component: r.cycle for r in condensation.component_cycles(spark, df, c, "a", "b").collect()}
        assert set(cycles) == set(of.values())
        for start, cycle in cycles.items():
            pairs = {(a, b) for a, b, _ in edges}
            assert cycle[0] == start and all(p in pairs for p in zip(cycle, [*cycle[1:], start], strict=True)) and len(set(cycle)) == len(cycle)
            queue, far = deque([(start, 0)]), {}
            while queue:
                x, d = queue.popleft()
                for a, b in pairs:
                    if a == x and b not in far and a != b:
                        far[b] = d + 1
                        queue.append((b, d + 1))
            assert len(cycle) == far[start]


def test_levels_behind_a_cycle_are_null(spark):
    dag = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "source long, target long")
    got = condensation.levels(spark, spark.createDataFrame([(9,), (None,)], "node long"), dag).collect()
    assert {r.node: r.level for r in got} == {1: 0, 9: 0, 2: None, 3: None, 4: None}
    assert condensation.levels(spark, dag.select("source").where("false").withColumnRenamed("source", "node"), dag.where("false")).count() == 0
