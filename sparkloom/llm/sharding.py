"""Operator 10: shards by jump consistent hashing, with slots inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bins_for
from .text import hash_bin


#: Steps that nearly every key gets by with, whatever the number of shards.
FEW = 48


def jump_hash(key: Column, shards: int) -> Column:
    """Jump consistent hash of ``key`` into ``shards``; no ring table.

    The generator that drives the jumps is ``xxhash64(key, step)``. A jump always leads further, so ``shards`` steps
    suffice; about ln(shards) are needed, so what FEW steps leave over is rare and looked at apart. With one more shard a key either stays or moves into the new one. A null key hashes like any other value.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        onward = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(state["j"] < shards, F.struct(state["j"].alias("b"), onward.alias("j"))).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    few = min(shards, FEW)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    if few < shards:  # the rest is evaluated only for keys that need it
        state = F.when(state["j"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(few + 1), F.lit(shards)), state, step))
    return state["b"].cast("int")


def assign_shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Every row with ``shard``, ``grown_shard`` (with one shard more), ``size``, ``text_crc32`` and ``slot``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1); ``text_crc32`` is that of no bytes, 0, for a null text. ``slot`` counts from 0
    without gaps in each shard: shards are cut into bins of a hash of id and text, bins are counted, and a row's slot is the
    count of the bins before plus its place in its own bin, so no task sorts a whole shard, nor all texts of one id. Rows
    with equal ids share a shard and get slots of their own. Columns of the same names in ``df`` are replaced; an empty table stays empty;
    null ids are one id; texts of any length are only measured.
    """
    made = ["shard", "grown_shard", "size", "text_crc32", "slot"]
    if id_col in made or text_col in made:
        raise ValueError("rename the id or text column first")
    bins = bins_for(df.count())
    df = df.drop(*made)
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(10))

    def place(rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", jump_hash(F.col(id_col), shards)).withColumn("_shard_bin", hash_bin(key, bins))

    counts = place(df.select(id_col, text_col)).groupBy("shard", "_shard_bin").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_shard_bin")) - F.col("count")
    starts = counts.select("shard", "_shard_bin", before.alias("_shard_before"))
    rows = (
        place(df)
        .withColumn("grown_shard", jump_hash(F.col(id_col), shards + 1))
        .withColumn("size", (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
        .withColumn("_shard_key", key)
    )
    own = Window.partitionBy("shard", "_shard_bin").orderBy("_shard_key", id_col, "text_crc32", "size")
    return (
        rows.withColumn("_shard_row", F.row_number().over(own))
        .join(starts, ["shard", "_shard_bin"])
        .withColumn("slot", F.col("_shard_before") + F.col("_shard_row") - 1)
        .drop("_shard_bin", "_shard_key", "_shard_row", "_shard_before")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows as Parquet, one folder a shard; rows of one shard are spread over several files, not one task.

    Null columns are written as they are, a null ``shard`` under Spark's default name; an empty table leaves an empty folder.
    """
    sharded.write.partitionBy("shard").mode("overwrite").parquet(path)
