"""The graph of strong components: its edges, levels, a cycle of each component, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Stage


def condense(edges: DataFrame, components: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """``source, target, n_edges, least``: edges between components, counted, with the least ``weight`` of each pair.

    ``components`` has ``node, component``; a node that it lacks is a component of its own, under its own name.
    """
    of = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
    rows = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(weight).alias("w")).where("a IS NOT NULL AND b IS NOT NULL")
    rows = rows.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("source"), F.coalesce("_b", "b").alias("target"), "w")
    return rows.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n_edges"), F.min("w").alias("least"))


def levels(spark: SparkSession, nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """``node, level``: 0 where nothing comes in, else one more than the greatest level before it.

    ``nodes`` has ``node``, ``dag`` ``source, target`` without cycles (nodes of a cycle, and those behind one, get null).
    By peeling: each round takes the nodes without edges in and their edges; rounds are written tables, as many as there
    are levels.
    """
    stage = Stage(spark, "levels")
    left = stage.save(nodes.select("node").unionByName(dag.select(F.col("source").alias("node"))).unionByName(dag.select(F.col("target").alias("node"))).where("node IS NOT NULL").distinct())
    edges = stage.save(dag.select("source", "target").distinct())
    out, level = [], 0
    while True:
        free = stage.save(left.join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        out.append(free.withColumn("level", F.lit(level)))
        left = stage.save(left.join(free, "node", "left_anti"))
        edges = stage.save(edges.join(free.withColumnRenamed("node", "source"), "source", "left_anti"))
        level += 1
    out.append(left.withColumn("level", F.lit(None).cast("int")))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def component_cycles(spark: SparkSession, edges: DataFrame, components: DataFrame, source: str, target: str) -> DataFrame:
    """``component, cycle``: a shortest cycle through the least node of each component, from that node on.

    A search from the least node that stays in the component and reaches each node once, with its way back; of several
    shortest cycles the one whose nodes, read backwards, come first. As many rounds as the longest of these cycles has
    nodes; components whose cycle is found leave the search.
    """
    stage = Stage(spark, "component-cycles")
    of = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
    inside = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct().join(of("a"), "a").join(of("b"), "b").where("_a = _b AND a <> b")
    inside = stage.save(inside.select(F.col("_a").alias("component"), "a", "b"))
    starts = components.groupBy("component").agg(F.min("node").alias("start"))
    at = stage.save(starts.select("component", "start", F.col("start").alias("node"), F.array("start").alias("back")))
    seen, found = at.select("component", "node"), []
    while not at.isEmpty():
        onward = at.join(inside, ["component"]).where("node = a").select("component", "start", F.col("b").alias("node"), "back")
        closed = stage.save(onward.where("node = start").groupBy("component").agg(F.min("back").alias("back")))
        found.append(closed)
        onward = onward.join(closed.select("component"), "component", "left_anti").join(seen, ["component", "node"], "left_anti")
        grown = onward.groupBy("component", "start", "node").agg(F.min("back").alias("back"))
        at = stage.save(grown.select("component", "start", "node", F.concat(F.array("node"), "back").alias("back")))
        seen = stage.save(seen.unionByName(at.select("component", "node")))
    every = found[0] if found else at.select("component", "back")
    for one in found[1:]:
        every = every.unionByName(one)
    return every.select("component", F.reverse("back").alias("cycle"))


def summary(nodes: DataFrame, edges: DataFrame, components: DataFrame, connectivity: DataFrame, source: str, target: str, origin: str, score: str) -> DataFrame:
    """One row: counts of nodes, edges, edges by origin (explicit or inferred) and confidence, cycles, isolated nodes.

    A component of two nodes or more has one cycle of the summary. Confidence is high from 0.75 and medium from 0.45.
    """
    e = edges.agg(
        F.count("*").alias("n_edges"), F.count_if(F.col(origin) == "explicit").alias("n_explicit"), F.count_if(F.col(origin) != "explicit").alias("n_inferred"),
        F.count_if(F.col(score) >= 0.75).alias("n_high"), F.count_if((F.col(score) >= 0.45) & (F.col(score) < 0.75)).alias("n_medium"), F.count_if(F.col(score) < 0.45).alias("n_low"),
    )
    c = components.agg(F.count_distinct("component").alias("n_cycles"), F.count("*").alias("n_in_cycles"))
    k = connectivity.agg(*[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in ("isolated", "root", "leaf", "inner")])
    one = F.lit(1).alias("_one")  # of each table a single row
    out = nodes.agg(F.count("*").alias("n_nodes")).select("*", one)
    for table in (e, c, k):
        out = out.join(table.select("*", one), "_one")
    return out.drop("_one")
