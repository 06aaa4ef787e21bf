"""Ordered folds whose state is bounded: budgets, score bumps, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import Stage


#: Rows of a group that one round of a fold looks at.
LOOKED_AT = 256


def placed(stage: Stage, df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``place``, the number of each row in its group in order; a hot group is spread over many tasks.

    The rows are dealt by range of (keys, order) and sorted; the rows of a group before a task's are counted by task.
    """
    # rows that are equal in all of it can be split too
    tied = df.withColumn("_placed_tie", F.monotonically_increasing_id())
    rows = tied.repartitionByRange(*[F.col(k) for k in keys], *order, F.col("_placed_tie")).sortWithinPartitions(*keys, *order, "_placed_tie").drop("_placed_tie")
    rows = stage.save(rows.withColumns({"_placed_task": F.spark_partition_id(), "_placed_row": F.monotonically_increasing_id()}))
    w = Window.partitionBy(*keys).orderBy("_placed_task")
    tasks = rows.groupBy(*keys, "_placed_task").agg(F.count("*").alias("_n"), F.min("_placed_row").alias("_first"))
    starts = tasks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_placed_task").alias("_t"), "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    same = F.col("_placed_task") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(starts, same)
    return out.select(*df.columns, (F.col("_before") + F.col("_placed_row") - F.col("_first") + 1).alias("place"))


def fill_budget(spark: SparkSession, df: DataFrame, keys: list[str], order: list[Column], item: str, cost: str, budget: int) -> DataFrame:
    """``keys, item, cost, place, admitted``: in order, an item is admitted if it still fits, else skipped; later ones may fit.

    Every row of a group is tried, in rounds: what is left of a group's budget only shrinks, so a row above it is out
    for good. A round takes the next LOOKED_AT rows of each group that are not, and folds them; it admits the first of
    them at least. Rows without a cost are not admitted, those of no cost always. Groups are never in one task whole.
    """
    stage = Stage(spark, "budget")
    rows = placed(stage, df.withColumn(cost, F.col(cost).cast("long")), keys, order)
    rows = stage.save(rows.select(*keys, item, cost, F.col("place").cast("int").alias("place")))
    group = F.struct(*[F.col(k) for k in keys])  # null is a key like others
    live = rows.where((F.col(cost) > 0) & (F.col(cost) <= budget)).select(group.alias("_g"), "place", F.col(cost).alias("_c"))
    state = stage.save(live.select("_g", F.lit(0).cast("long").alias("_used"), F.lit(0).alias("_after")).distinct())
    admitted = None
    while True:
        open_ = live.join(state, "_g").where((F.col("place") > F.col("_after")) & (F.col("_used") + F.col("_c") <= budget))
        w = Window.partitionBy("_g").orderBy("place")
        block = open_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= LOOKED_AT)
        start = F.struct(F.col("_used").alias("used"), F.array().cast("array<int>").alias("took"))

        def step(acc: Column, x: Column) -> Column:
            fits = acc["used"] + x["_c"] <= budget
            took = F.struct((acc["used"] + x["_c"]).alias("used"), F.concat(acc["took"], F.array(x["place"])).alias("took"))
            return F.when(fits, took).otherwise(acc)

        lists = block.groupBy("_g", "_used").agg(F.sort_array(F.collect_list(F.struct("place", "_c"))).alias("_rows"))
        folded = lists.withColumn("_x", F.aggregate("_rows", start, step))
        folded = stage.save(folded.select("_g", F.col("_x.used").alias("_used"), F.col("_x.took").alias("_took"), F.element_at("_rows", -1)["place"].alias("_after")))
        if folded.isEmpty():
            break
        took = folded.select("_g", F.explode("_took").alias("place"))
        admitted = took if admitted is None else admitted.unionByName(took)
        state = folded.select("_g", "_used", "_after")
    free = F.coalesce(F.col(cost) <= 0, F.lit(False))
    if admitted is None:
        return rows.withColumn("admitted", free)
    hit = admitted.withColumn("_hit", F.lit(True))
    out = rows.withColumn("_g", group).join(hit, ["_g", "place"], "left")
    return out.select(*keys, item, cost, "place", (free | F.coalesce("_hit", F.lit(False))).alias("admitted"))


def merge_scores(df: DataFrame, keys: list[str], score: str, explicit: str) -> DataFrame:
    """``keys, score, explicit, n``: the highest score; in ascending order each differing one adds 0.05 unless a row is explicit.

    Equal scores fold at once, so a group is held as its distinct scores (three decimals, 1,001 at most).
    """
    rounded = df.withColumn("_s", F.bround(F.col(score) * 1000).cast("long"))
    runs = rounded.groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.max(explicit).alias("_e"))
    rows = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_s", "_n"))).alias("_rows"), F.max("_e").alias("explicit"), F.sum("_n").alias("n"), F.max("_s").alias("_top"))

    def step(state: Column, x: Column) -> Column:
        bumped = F.least(F.lit(1000).cast("long"), F.greatest(state, x["_s"]) + 50 * x["_n"])
        return F.when(state < 0, x["_s"]).when(state == x["_s"], state).otherwise(bumped)

    folded = F.aggregate("_rows", F.lit(-1).cast("long"), step)
    return rows.select(*keys, (F.when(F.col("explicit"), F.col("_top")).otherwise(folded) / 1000).alias("score"), "explicit", "n")


def first_and_conflicts(df: DataFrame, identity: list[str], order: str, payload: list[str]) -> DataFrame:
    """One row per identity: the first payload by ``order``, ``n`` rows and whether another has a different payload."""
    digest = F.xxhash64(*payload)
    first = F.min(F.struct(order, *payload)).alias("_first")
    out = df.groupBy(*identity).agg(first, F.count("*").alias("n"), (F.min(digest) != F.max(digest)).alias("conflict"))
    return out.select(*identity, *[F.col(f"_first.{c}").alias(c) for c in (order, *payload)], "n", "conflict")
