"""Lookups: cascades, prefixes, templates and missing partners. All are equi-joins on derived keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_cascade(df: DataFrame, key: str, candidates: Column, index: DataFrame, index_key: str) -> DataFrame:
    """``df`` rows by ``key`` with ``resolved`` and ``step``: the first of the candidates that the index has, or null."""
    tried = df.select(key, F.posexplode_outer(candidates).alias("step", "_try"))
    hits = tried.join(index.select(F.col(index_key).alias("_try")).distinct(), "_try").groupBy(key).agg(F.min(F.struct("step", "_try")).alias("_hit"))
    return df.join(hits, key, "left").withColumn("resolved", F.col("_hit._try")).withColumn("step", F.col("_hit.step")).drop("_hit")


def longest_prefix(df: DataFrame, key: str, name: str, entries: DataFrame, entry: str, separator: str = "/") -> DataFrame:
    """``key, entry``: the longest entry that is the name or ends before one of its separators.

    A name is expanded to its own prefixes, so this is an equi-join, not a comparison of all names with all entries.
    """
    parts = F.split(F.col(name), separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    tried = df.select(key, F.explode(prefixes).alias(entry))
    return tried.join(entries.select(entry).distinct(), entry).groupBy(key).agg(F.max_by(entry, F.char_length(entry)).alias(entry))


def missing_partners(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def neighbours_of_set(edges: DataFrame, members: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """``node, direction`` of the distinct nodes outside the set that an edge links to it, edges inside left out."""
    inside_from, inside_to = members.select(F.col(member).alias(source)), members.select(F.col(member).alias(target))
    out = edges.join(inside_from, source, "left_semi").join(inside_to, target, "left_anti").select(F.col(target).alias("node"), F.lit("out").alias("direction"))
    into = edges.join(inside_to, target, "left_semi").join(inside_from, source, "left_anti").select(F.col(source).alias("node"), F.lit("in").alias("direction"))
    return out.unionByName(into).distinct()
