"""Streams of facts: windowed counts with late data, first-seen rows, snapshot changes per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import fingerprint_diff


def windowed_counts(stream: DataFrame, time: str, key: str, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, key, n`` by tumbling window; rows later than the watermark are dropped. Works on batch tables too."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take no other type
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, *, late: str = "2 hours") -> DataFrame:
    """Each key once while the watermark remembers it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def apply_changes(spark, known_path: str, changes_path: str, key: str, fingerprint: str, order: str | None = None):
    """A ``foreachBatch`` function: compares a batch with what is known, writes the changes, then the new state.

    Of several rows of a key in a batch the one with the greatest ``order`` counts (without one, the greatest
    fingerprint). The state is one row a key, a table for each batch; a batch that runs twice starts from the state
    before it and writes the same again. States older than the one before are deleted.
    """
    jvm = spark.sparkContext._jvm

    def folder(path: str):
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def earlier(number: int) -> list[int]:
        where, files = folder(known_path)
        if not files.exists(where):
            return []
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and int(n.removeprefix("version=")) < number)

    def on_batch(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(fingerprint, order or fingerprint).alias(fingerprint))
        before = earlier(number)
        known = spark.read.parquet(f"{known_path}/version={before[-1]}") if before else newest.where("false")
        known = known.select(key, fingerprint)
        touched = known.join(newest.select(key), key, "left_semi")
        changes = fingerprint_diff(touched, newest, key, fingerprint).withColumn("version", F.lit(number))
        changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(changes_path)
        state = known.join(newest.select(key), key, "left_anti").unionByName(newest)
        state.write.mode("overwrite").parquet(f"{known_path}/version={number}")
        for old in before[:-1]:
            where, files = folder(f"{known_path}/version={old}")
            files.delete(where, True)

    return on_batch
