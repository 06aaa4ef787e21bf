"""Differences of tables, agreement between sources, status roll-ups and selection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of both with ``status``: added, removed or kept; one shuffle for both tables."""
    both = old.select(*columns, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(*columns, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    out = both.groupBy(*columns).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    return out.select(*columns, F.when(F.col("_o") == 0, "added").when(F.col("_n") == 0, "removed").otherwise("kept").alias("status"))


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """``key, status`` of the keys that were added, removed or changed."""
    a, b = old.select(key, F.col(fingerprint).alias("_a"), F.lit(True).alias("_in_a")), new.select(key, F.col(fingerprint).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where(F.col("status").isNotNull())


def duplicates(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, n, first_item, last_item`` of the keys with several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(item).alias("first_item"), F.max(item).alias("last_item")).where("n > 1")


def status_by_rules(df: DataFrame, fail: Column, warn: Column, name: str = "status") -> DataFrame:
    return df.withColumn(name, F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS"))


def first_status(df: DataFrame, keys: list[str], status: str, precedence: list[str], default: str) -> DataFrame:
    """``keys, status``: the status of the highest precedence that a group has."""
    known = F.array(*[F.lit(s) for s in precedence])
    at = F.array_position(known, F.col(status))
    least = F.min(F.when(at > 0, at)).alias("_at")
    return df.groupBy(*keys).agg(least).select(*keys, F.coalesce(F.get(known, (F.col("_at") - 1).cast("int")), F.lit(default)).alias(status))


def agreement_pairs(df: DataFrame, item: str, party: str, value: str) -> DataFrame:
    """``a, b, n_agree, n_differ`` of each unordered pair of parties over the items that both have; one value per item and party."""
    a = df.select(item, F.col(party).alias("a"), F.col(value).alias("_va"))
    b = df.select(item, F.col(party).alias("b"), F.col(value).alias("_vb"))
    same = F.col("_va").eqNullSafe(F.col("_vb"))
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count_if(same).alias("n_agree"), F.count_if(~same).alias("n_differ"))


def quality_at_k(ranked: DataFrame, expected: DataFrame, task: str, item: str, rank: str, tier: str, k: int) -> DataFrame:
    """One row a task: recall, coverage, distractor rate and waste of its first ``k`` items against the tiers expected.

    Items of no tier are waste; an empty tier counts as reached, an empty selection as no waste.
    """
    total = expected.groupBy(task).agg(F.count_if(F.col(tier) == "critical").alias("_critical"), F.count_if(F.col(tier) == "useful").alias("_useful"))
    first = ranked.where(F.col(rank) <= k).select(task, item)
    hits = first.join(expected, [task, item], "left").groupBy(task).agg(
        F.count("*").alias("evaluated"), F.count_if(F.col(tier) == "critical").alias("_c"), F.count_if(F.col(tier) == "useful").alias("_u"), F.count_if(F.col(tier) == "distractor").alias("_d")
    )
    rows = total.join(hits, task, "full_outer").fillna(0)

    def share(part: Column, whole: Column, empty: float) -> Column:
        return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)

    c, u, d, n = (F.col(x) for x in ("_c", "_u", "_d", "evaluated"))
    return rows.select(
        task, "evaluated", share(c, F.col("_critical"), 1.0).alias("critical_recall"), share(u, F.col("_useful"), 1.0).alias("useful_coverage"),
        share(d, n, 0.0).alias("distractor_rate"), (F.col("_critical") - c).alias("missed_critical"), share(n - c - u, n, 0.0).alias("context_waste"),
    )


def group_digests(df: DataFrame, keys: list[str], line: Column, digits: int = 4) -> DataFrame:
    """``keys, digest, n``: a SHA-256 of each group's lines, whatever their order; equal lines count as often as they come.

    Each line is digested; the digests are put together in order by their first ``digits`` hexadecimal digits, and these
    again for the group. So no task holds a group's lines, only those of a bin, and the list of its bins, at most
    16^digits. A null line is a line of its own.
    """
    own = df.select(*keys, F.sha2(F.coalesce(line.cast("string"), F.lit("\x00")), 256).alias("_h"))
    bins = own.groupBy(*keys, F.substring("_h", 1, digits).alias("_bin")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ","), 256).alias("_d"), F.count("*").alias("_n"))
    of_bins = F.transform(F.sort_array(F.collect_list(F.struct("_bin", "_d"))), lambda x: x["_d"])
    return bins.groupBy(*keys).agg(F.sha2(F.array_join(of_bins, ","), 256).alias("digest"), F.sum("_n").alias("n"))
