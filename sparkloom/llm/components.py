"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Stage


def connected_components(stage: Stage, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is the smallest node reachable.

    Each round is two joins on nodes with a pre-aggregated minimum; a hub's rows can be split among tasks. The table
    of a round is written, so a lost executor costs one round at most. Self links count as no link.
    """
    edges = stage.save(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.save(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        small = stage.save(small.distinct())
        stage.drop(large)
        stage.drop(edges)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest that the links ``a, b`` lead to, by repeated minima and pointer jumps."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            break
    return root
