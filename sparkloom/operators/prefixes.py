"""Composition of path prefixes along a graph of mounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Stage, unsent

#: Walks that a round may send to all executors; more are shuffled.
FEW_WALKS = 10_000


def joined(prefix: Column, path: Column, slashes: bool) -> Column:
    """One path of two: with exactly one slash between parts, or as they are."""
    if not slashes:
        return F.concat(prefix, path)
    whole = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "/{2,}", "/")
    return F.when(whole == "/", whole).otherwise(F.regexp_replace(whole, "/$", ""))


def mounted_prefixes(spark: SparkSession, nodes: DataFrame, mounts: DataFrame, *, slashes: bool = True) -> DataFrame:
    """``node, root, prefix, depth``: every prefix under which a node of ``nodes`` (column ``node``) is reached.

    ``mounts`` has ``parent, prefix, child``. Roots are the nodes that nothing mounts. A node that is mounted in
    several places, or several times, has a row for each different prefix, with the least depth. A mount that leads back
    to a node of its own walk ends there, so cycles end; nodes that only a cycle reaches have no row. Null ends of a mount,
    and mounts of a node on itself, lead nowhere.

    A fixpoint join: each round joins the walks of the last with the mounts by ``parent`` and is written, so a lost
    executor costs a round. A walk carries its nodes, of which there are as many as the deepest nesting.
    """
    stage = Stage(spark, "prefixes")
    edges = stage.save(mounts.select("parent", F.coalesce("prefix", F.lit("")).alias("p"), "child").where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").distinct())
    roots = nodes.select("node").where("node IS NOT NULL").distinct().join(unsent(edges.select(F.col("child").alias("node")).distinct()), "node", "left_anti")
    walks = stage.save(roots.select("node", F.col("node").alias("root"), F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.array("node").alias("seen")))
    rounds = [walks]
    while n := walks.count():
        at = F.broadcast(walks) if n <= FEW_WALKS else unsent(walks)
        onward = at.join(edges, F.col("node") == F.col("parent")).where(~F.array_contains("seen", F.col("child")))
        walks = stage.save(
            onward.select(F.col("child").alias("node"), "root", joined(F.col("prefix"), F.col("p"), slashes).alias("prefix"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("child")).alias("seen")).distinct()
        )
        rounds.append(walks)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.groupBy("node", "root", "prefix").agg(F.min("depth").alias("depth"))


def full_routes(spark: SparkSession, routes: DataFrame, mounts: DataFrame, *, slashes: bool = True) -> DataFrame:
    """``root, node, url, method, handler, confidence, depth`` of ``routes`` (``node, method, path, handler``).

    ``mounts`` has ``parent, prefix, child, target``; ``child`` is null where the target is not known. A route counts
    once for each prefix of its node, with high confidence; an unresolved mount counts as a route of any method to
    its target, with low confidence; a route of a node that only a cycle of mounts reaches keeps its own path, with
    low confidence and a null root. Null paths are empty. Rows that are the same but for their handlers stay apart.
    """
    # written, as both are read several times and may have been parsed from texts
    stage = Stage(spark, "routes")
    routes, mounts = stage.save(routes.select("node", "method", "path", "handler")), stage.save(mounts.select("parent", "prefix", "child", "target"))
    nodes = routes.select("node").unionByName(mounts.select(F.col("parent").alias("node"))).unionByName(mounts.select(F.col("child").alias("node")))
    prefixes = mounted_prefixes(spark, nodes, mounts, slashes=slashes)
    path = F.coalesce("path", F.lit(""))
    own = routes.select("node", "method", path.alias("path"), "handler", F.lit("high").alias("sure"))
    open_ends = mounts.where("child IS NULL").select(F.col("parent").alias("node"), F.lit("ANY").alias("method"), F.coalesce("prefix", F.lit("")).alias("path"), F.col("target").alias("handler"), F.lit("low").alias("sure"))
    rows = own.unionByName(open_ends).join(unsent(prefixes), "node", "left")
    lost = F.col("root").isNull()
    return rows.select(
        "root", "node", joined(F.coalesce("prefix", F.lit("")), F.col("path"), slashes).alias("url"), "method", "handler",
        F.when(lost, "low").otherwise(F.col("sure")).alias("confidence"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
