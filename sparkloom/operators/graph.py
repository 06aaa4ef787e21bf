"""Reachability, cycles, components, walks and bounded traversals on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import Stage, unsent

#: Rounds after which the known rows of a reachability are written as one table again.
MERGED = 8


def reachable(spark: SparkSession, edges: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """``seed, node, depth`` of all nodes that edges lead to from each seed (a column ``seed``), the seed only by a cycle.

    Each round joins the newest nodes with the edges and drops what is known, until there is nothing new. Rounds are
    written tables, and those of several rounds are merged, so no round reads many.
    """
    stage = Stage(spark, "reach")
    steps = stage.save(edges.select(F.col(source).alias("_from"), F.col(target).alias("node")).distinct())
    new = seeds.select("seed").distinct().join(steps, F.col("seed") == F.col("_from")).select("seed", "node", F.lit(1).alias("depth"))
    new = stage.save(new.distinct())
    known, depth = new, 1
    while not new.isEmpty():
        depth += 1
        grown = new.join(steps.withColumnRenamed("node", "_to"), F.col("node") == F.col("_from")).select("seed", F.col("_to").alias("node")).distinct()
        new = stage.save(grown.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(new)
        if depth % MERGED == 0:
            known = stage.save(known)
    return known


def cycles(spark: SparkSession, edges: DataFrame, source: str, target: str, *, most_nodes: int | None = None) -> DataFrame:
    """``path``: each simple cycle once, starting at its smallest node and ending before it.

    Paths grow by joins and only through nodes above their start, so a cycle is found in one rotation. Their number is
    exponential in the graph; a caller who wants no cycles longer than ``most_nodes`` says so, else all are found.
    """
    stage = Stage(spark, "cycles")
    steps = stage.save(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct())
    found = steps.where("_from = _to").select(F.array("_from").alias("path"))
    paths = stage.save(steps.where("_from < _to").select(F.array("_from", "_to").alias("path")))
    length = 2
    while (most_nodes is None or length <= most_nodes) and not paths.isEmpty():
        ended = paths.join(steps, (F.element_at("path", -1) == F.col("_from")) & (F.element_at("path", 1) == F.col("_to"))).select("path")
        found = found.unionByName(ended)
        grown = paths.join(steps, F.element_at("path", -1) == F.col("_from")).where((F.col("_to") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("_to")))
        paths = stage.save(grown.select(F.concat("path", F.array("_to")).alias("path")))
        length += 1
    return found


def _size(edges: DataFrame) -> int:
    return edges.count()


def strong_components(spark: SparkSession, edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node, component``: nodes that reach each other share the smallest of them; components of one node are left out.

    By colouring: edges whose ends lack an edge in or out are trimmed until none is left; every node takes the smallest
    node that leads to it; of each colour, the nodes that lead back to it within the colour are its component. They
    leave, and the rest goes on. The tables never exceed the edges, and no join sends one around.
    """
    stage = Stage(spark, "scc")
    live = stage.save(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b").distinct())
    found = live.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    left = _size(live)
    while left:
        while True:  # trim
            kept = live.join(unsent(live.select(F.col("b").alias("a")).distinct()), "a", "left_semi").join(unsent(live.select(F.col("a").alias("b")).distinct()), "b", "left_semi")
            live, before = stage.save(kept.select("a", "b")), left
            left = _size(live)
            if left == before:
                break
        if not left:
            break
        colour = stage.save(live.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            offered = live.join(unsent(colour), F.col("a") == F.col("node")).select(F.col("b").alias("node"), "colour")
            new = stage.save(colour.unionByName(offered).groupBy("node").agg(F.min("colour").alias("colour")))
            changed = not new.join(unsent(colour), ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if not changed:
                break
        inside = live.join(unsent(colour.select(F.col("node").alias("a"), F.col("colour").alias("c"))), "a").join(unsent(colour.select(F.col("node").alias("b"), F.col("colour").alias("d"))), "b")
        inside = stage.save(inside.where("c = d").select("a", "b", "c"))
        back = stage.save(colour.where("node = colour").select("node", "colour"))
        newest = back
        while not newest.isEmpty():
            grown = inside.join(unsent(newest), (F.col("b") == F.col("node")) & (F.col("c") == F.col("colour"))).select(F.col("a").alias("node"), "colour").distinct()
            newest = stage.save(grown.join(unsent(back), ["node", "colour"], "left_anti"))
            back = stage.save(back.unionByName(newest))
        found = found.unionByName(back.select("node", F.col("colour").alias("component")))
        gone = unsent(back.select("node"))
        live = stage.save(live.join(gone, F.col("a") == F.col("node"), "left_anti").join(gone, F.col("b") == F.col("node"), "left_anti"))
        left = _size(live)
    several = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(unsent(several), "component", "left_semi").select("node", "component")


def connectivity(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """``node, n_in, n_out, kind``: isolated, root (nothing comes in), leaf (nothing goes out) or inner; loops don't count."""
    proper = edges.where(F.col(source) != F.col(target))
    into = proper.groupBy(F.col(target).alias("node")).agg(F.count("*").alias("n_in"))
    out = proper.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("n_out"))
    all_ = nodes.select(F.col(node).alias("node")).distinct().join(into, "node", "left").join(out, "node", "left").fillna(0, ["n_in", "n_out"])
    kind = F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "isolated").when(F.col("n_in") == 0, "root").when(F.col("n_out") == 0, "leaf").otherwise("inner")
    return all_.withColumn("kind", kind)


def best_walk(spark: SparkSession, edges: DataFrame, starts: DataFrame, source: str, target: str, score: str, *, most_steps: int = 20) -> DataFrame:
    """``seed, step, node``: from each seed always the best successor (highest score, then smallest), until a repeat."""
    stage = Stage(spark, "walk")
    best = edges.groupBy(F.col(source).alias("_from")).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(target).alias("_to"))).alias("_x"))
    best = stage.save(best.select("_from", "_x._to"))
    at = starts.select("seed", F.array("seed").alias("path"))
    for _ in range(most_steps - 1):
        at = at.join(best, F.element_at("path", -1) == F.col("_from"), "left")
        go = F.col("_to").isNotNull() & ~F.array_contains("path", F.col("_to"))
        at = at.select("seed", F.when(F.coalesce(go, F.lit(False)), F.concat("path", F.array("_to"))).otherwise(F.col("path")).alias("path"))
    return at.select("seed", F.posexplode("path").alias("step", "node"))


def _taken(edges: Column, depth: Column, n: Column, cost: Column, max_edges: int, max_cost: float) -> Column:
    """``n, cost, stop, more`` after the edges in order, until a cap stops them; ``more`` joins the frontier."""
    start = F.struct(n.alias("n"), cost.alias("cost"), F.lit(None).cast("string").alias("stop"), F.transform(F.slice(edges, 1, 0), lambda e: F.struct(e["rank"].alias("rank"), e["cost"].alias("cost"), depth.alias("depth"), e["target"].alias("node"))).alias("more"))

    def step(s: Column, e: Column) -> Column:
        full, dear = s["n"] >= max_edges, s["cost"] + e["cost"] > max_cost
        stopped = lambda why: F.struct(s["n"].alias("n"), s["cost"].alias("cost"), why.alias("stop"), s["more"].alias("more"))
        one = F.array(F.struct(e["rank"].alias("rank"), e["cost"].alias("cost"), (depth + 1).alias("depth"), e["target"].alias("node")))
        took = F.struct((s["n"] + 1).alias("n"), (s["cost"] + e["cost"]).alias("cost"), F.when(s["n"] + 1 >= max_edges, "edges").alias("stop"), F.concat(s["more"], one).alias("more"))
        return F.when(s["stop"].isNotNull(), s).when(full, stopped(F.lit("edges"))).when(dear, stopped(F.lit("cost"))).otherwise(took)

    return F.aggregate(edges, start, step)


def traverse(edges: DataFrame, seeds: DataFrame, *, max_depth: int = 2, max_files: int = 40, max_edges: int = 100, max_cost: float = 100.0) -> DataFrame:
    """``seed, place, node, depth, n_edges, cost, stop``: the nodes that a best-first traversal visits from each seed, in order.

    ``edges``: source, target, rank (smaller first), cost, ord (the order of a node's edges). From the frontier the node
    of least (rank, cost, depth, name) is visited next, its edges are taken in order, and a node in the frontier keeps
    its better key. ``stop`` names the cap that ended the traversal: files, edges or cost; null if the frontier ran dry.
    At most ``max_edges`` edges are taken in all, so no more than that of a node are read.

    All traversals take a step at a time: a round joins each seed's next node with that node's edges, and is written. A
    seed is one row with its frontier (at most ``max_edges``) and the nodes that it has seen (at most ``max_files``), so
    the tables never exceed the seeds by more than the caps, whatever the depth; finished seeds leave the rounds.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "traverse")
    own = Window.partitionBy("source").orderBy("ord", "target")
    steps = edges.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= max_edges + 1)
    entry = F.struct("_n", F.col("rank").cast("long").alias("rank"), F.col("cost").cast("double").alias("cost"), "target")
    lists = stage.save(steps.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("edges")))
    first = F.struct(F.lit(-1).cast("long").alias("rank"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("depth"), F.col("seed").alias("node"))
    visited = F.struct(F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth"))
    at = seeds.select("seed").where("seed IS NOT NULL").distinct().select("seed", F.array(first).alias("front"), F.slice(F.array(visited), 1, 0).alias("seen"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("stop"))
    done = []
    for _ in range(max_files + 1):
        new = F.filter("front", lambda x: ~F.exists("seen", lambda y: y["node"] == x["node"]))
        at = at.withColumn("front", F.when(F.col("stop").isNull(), new).otherwise(F.col("front")))
        at = at.withColumn("stop", F.when(F.col("stop").isNull() & (F.size("front") > 0) & (F.size("seen") >= max_files), "files").otherwise(F.col("stop")))
        at = stage.save(at)
        over = F.col("stop").isNotNull() | (F.size("front") == 0)
        done.append(at.where(over).select("seed", "seen", "n", "cost", "stop"))
        live = at.where(~over)
        if live.isEmpty():
            break
        pick = live.withColumn("pick", F.array_min("front")).withColumn("node", F.col("pick.node"))
        met = pick.join(lists, "node", "left")
        none = F.slice(F.coalesce("edges", F.array().cast(lists.schema["edges"].dataType)), 1, 0)
        usable = F.when((F.col("pick.depth") < max_depth) & F.col("edges").isNotNull(), F.col("edges")).otherwise(none)
        met = met.withColumn("took", _taken(usable, F.col("pick.depth"), F.col("n"), F.col("cost"), max_edges, max_cost))
        seen = F.concat("seen", F.array(F.struct(F.col("pick.node").alias("node"), F.col("pick.depth").alias("depth"))))
        at = met.select("seed", F.concat("front", F.col("took.more")).alias("front"), seen.alias("seen"), F.col("took.n").alias("n"), F.col("took.cost").alias("cost"), F.col("took.stop").alias("stop"))
    every = done[0]
    for one in done[1:]:
        every = every.unionByName(one)
    rows = every.select("seed", F.posexplode("seen").alias("place", "v"), "n", "cost", "stop")
    return rows.select("seed", (F.col("place") + 1).cast("long").alias("place"), "v.node", "v.depth", F.col("n").alias("n_edges"), "cost", "stop")
