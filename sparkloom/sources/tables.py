"""Snapshots by time, and tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates

#: Larger files are not read as sources.
MOST_BYTES = 2 << 20


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified, is_test, is_generated, folder_role, language`` of all files below ``root``; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    return files.select(
        path, F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        predicates.is_test_path(path).alias("is_test"), predicates.is_generated_path(path).alias("is_generated"),
        predicates.folder_role(path).alias("folder_role"), predicates.language(path).alias("language"),
    )


def source_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, text, sha256`` of the files below ``root`` that are UTF-8 without NUL bytes and not above MOST_BYTES."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
    text = F.call_function("try_validate_utf8", F.col("content").cast("string"))
    return files.select("path", text.alias("text"), F.sha2("content", 256).alias("sha256")).where(F.col("text").isNotNull() & (F.instr("text", "\0") == 0))


def write_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """A dated snapshot: one partition a stamp, replaced when it is written again."""
    df.withColumn("snapshot", F.lit(stamp)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("snapshot")).first()[0]
    return rows.where(F.col("snapshot") == newest)


def synthetic_relationships(spark: SparkSession, n: int) -> DataFrame:
    """Relationships for scale tests, a function of their number only."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row"), F.format_string("src/source_%05d.py", i).alias("source_path"), F.format_string("src/target_%03d.py", i % 97).alias("target_path"),
        F.format_string("/route/%d", i % 251).alias("route_path"), F.format_string("handler_%d", i % 89).alias("handler"), F.when(i % 3 == 0, "medium").otherwise("high").alias("confidence"),
    )


def synthetic_counts(files: Column) -> dict[str, Column]:
    """What a synthetic repository of so many files has."""
    candidates = F.ceil(files / 5).cast("long")
    edges = (F.greatest(files - 1, F.lit(0)) + F.floor(files / 2)).cast("long")
    return {"candidates": candidates, "edges": edges, "relationships": files * 2 + edges, "context_tokens": files * 6 + candidates * 12}


def synthetic_facts(spark: SparkSession, n: int) -> DataFrame:
    """Rows for scale tests, a function of their number only."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row"), F.format_string("src/module_%05d.py", i).alias("path"), (i * 37 % 8192 + 128).alias("size"),
        F.substring(F.sha2(i.cast("string"), 256), 1, 16).alias("digest"),
    )
