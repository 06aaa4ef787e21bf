"""Top-k, per-group limits and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered; Spark cuts groups to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys; of equal counts the larger key comes first."""
    return df.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.desc(key)).limit(k)


def bounded(df: DataFrame, keys: list[str], order: list[Column], k: int) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` of each group, and for each group how many were left out."""
    omitted = df.groupBy(*keys).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("omitted"))
    return top_per_group(df, keys, order, k), omitted


def best_or_ambiguous(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """One row a key: the highest score and, if only one candidate has it, that candidate; else null and ``ambiguous``."""
    by_score = df.groupBy(*keys, score).agg(F.count("*").alias("ties"), F.min(name).alias("_name"))
    out = by_score.groupBy(*keys).agg(F.max(F.struct(score, "ties", "_name")).alias("_b")).select(*keys, F.col(f"_b.{score}").alias(score), "_b.ties", "_b._name")
    return out.select(*keys, score, "ties", F.when(F.col("ties") == 1, F.col("_name")).alias(name), (F.col("ties") > 1).alias("ambiguous"))


def merged_lanes(lanes: list[DataFrame], key: str, group: str, *, per_lane: int, per_group: int, total: int) -> DataFrame:
    """``key, group, lane, place`` from lanes with a ``rank`` each: earlier lanes first, keys once, capped by group and in all.

    Every lane is cut to ``per_lane`` rows first, so what follows is a bounded table.
    """
    union = None
    for i, lane in enumerate(lanes):
        own = lane.orderBy("rank").limit(per_lane).select(key, group, F.lit(i).alias("lane"), "rank")
        union = own if union is None else union.unionByName(own)
    first = union.groupBy(key, group).agg(F.min(F.struct("lane", "rank")).alias("at")).select(key, group, "at.lane", "at.rank")
    kept = top_per_group(first, [group], [F.col("lane"), F.col("rank")], per_group, "in_group")
    return kept.orderBy("lane", "rank").limit(total).withColumn("place", F.row_number().over(Window.orderBy("lane", "rank")))
