"""Operator 9: mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Stage, bins_for
from .text import hash_bin, n_words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``target``: shares of the total by weight, none above ``most`` times its source.

    The sources in code point order, null last, take the weights in turn. What a capped source leaves is shared by the
    weights of the rest until none is above its cap; that is the level L at which the sum of min(cap, L * weight) is
    the total. Ordered by cap / weight, the capped sources come first, so prefix sums give L. One row a source.
    """
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - (F.sum("_cap").over(order) - F.col("_cap"))) / F.sum("_w").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    levels = caps.withColumn("_level", level).withColumn("_order", F.row_number().over(order))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_order", "_level"))
    return levels.withColumn("_found", F.min(fits).over(everything)).select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_found._level") * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def random_key(key: Column, seed: int) -> Column:
    """The first 60 bits of the MD5 of the key's text and the seed, as the top bits of a long."""
    digest = F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 4)


def mix_sources(
    spark: SparkSession,
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 9,
) -> DataFrame:
    """One row per input row: ``<id>, _text_key, source, size, source_size, target, taken``.

    Each source is sorted by a hash-random key (ties: id, then text). Its words are taken in that order, whole epochs
    first, and the last one is cut exactly where the words reach floor(target), so the document there is taken in part.
    The sort is by range: bins of the key are summed, prefix sums of the bins give each bin's start, and a window
    inside the bin gives the rest. A null text or one without words has size 0 and takes 0. Rows that are equal in id
    and text are rows of their own. Texts of any length are only counted. An empty table gives an empty result. ``_text_key`` is the text's hash.
    """
    stage = Stage(spark, "mixing")
    sized = stage.save(
        df.select(
            F.col(id_col).alias(id_col),
            F.xxhash64(text_col).alias("_text_key"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
        )
    )
    bins = bins_for(sized.count())
    # null ids are told apart by their texts, or all of them would lie in one bin
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.col("_text_key").cast("string")))
    keyed = sized.withColumn("_key", random_key(own, seed)).withColumn("_bin", hash_bin(F.col("_key"), bins))
    by_bin = keyed.groupBy("source", "_bin").agg(F.sum("size").alias("_bin_size"))
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("_bin_size").alias("source_size")), weights=weights, most=most)
    starts = by_bin.withColumn(
        "_start", F.sum("_bin_size").over(Window.partitionBy("source").orderBy("_bin")) - F.col("_bin_size")
    )
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("_source"), F.col("b._bin").alias("_b"), "_start", "source_size", "target"
    )
    # bits of the key as an unsigned number: flipping the sign bit makes the signed order the same
    inside = Window.partitionBy("source", "_bin").orderBy(F.col("_key").bitwiseXOR(F.lit(-(1 << 63))), id_col, "_text_key")
    placed = keyed.withColumn("_inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(
        stage.save(starts), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_b"))
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - (F.col("_start") + F.col("_inside"))
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return joined.select(id_col, "_text_key", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, whole, with the columns of ``df``.

    A document that the cut takes in part is repeated once more if at least half of it is taken. Rows equal in id and
    text share the copies that they get together, in the order of a hash of all columns. Null ids are ids of their own by
    text, null sources are a source; null texts are in no mix. An empty table gives an empty one.
    """
    plan = mix_sources(spark, df, id_col=id_col, text_col=text_col, **how)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    plan = plan.groupBy(F.col(id_col).alias("_mix_id"), F.col("_text_key").alias("_mix_text")).agg(
        F.sum(times).alias("_mix_times"), F.count("*").alias("_mix_rows")
    )
    joined = df.join(
        plan.where("_mix_times > 0"), F.col(id_col).eqNullSafe(F.col("_mix_id")) & (F.xxhash64(text_col) == F.col("_mix_text"))
    )
    # equal rows: with k copies for n equal rows, the first k % n of them get one more; which these are, a hash of
    # all columns says, so reruns agree
    twin = Window.partitionBy("_mix_id", "_mix_text").orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    several = joined.where("_mix_rows > 1").withColumn("_mix_i", F.row_number().over(twin))
    single = joined.where("_mix_rows = 1").withColumn("_mix_i", F.lit(1))
    share = F.floor(F.col("_mix_times") / F.col("_mix_rows")) + (F.col("_mix_i") <= F.col("_mix_times") % F.col("_mix_rows")).cast("long")
    out = single.unionByName(several).withColumn("_mix_copies", share).where("_mix_copies > 0")
    return out.select(*[F.col(c) for c in df.columns], F.explode(F.sequence(F.lit(1).cast("long"), "_mix_copies")).alias("_mix_c")).drop("_mix_c")
