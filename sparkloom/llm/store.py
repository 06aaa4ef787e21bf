"""The library's written tables, and what only this subpackage needs of them."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from ..store import Stage, shared_folder

__all__ = ["Stage", "bins_for", "release_shuffles", "shared_folder"]


def bins_for(rows: int, per_bin: int = 512, most: int = 1 << 16) -> int:
    """Number of hash bins, a power of two: about ``per_bin`` rows each until ``most`` bins are in use."""
    n = 1
    while n < most and rows > n * per_bin:
        n *= 2
    return n


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, where a later step needs the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
