"""Operator 8: optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Stage, bins_for
from .text import hash_bin, n_words

BUCKETS = 16
TOKEN_BUDGET = 65_536


def length_cell(n: Column) -> Column:
    """Cell of the histogram: exact below 512, then 256 cells for each power of two (at most 6,400 up to 2**31).

    Boundaries above 512 can thus lie up to 1/256 of a length above the best place: the padding of a row exceeds the
    optimum's by less than 0.4 % of its bucket's length.
    """
    shift = F.greatest(F.lit(0), F.length(F.bin(n)) - 9)
    return (shift * 256 + F.call_function("shiftright", n, shift)).cast("int")


def best_boundaries(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries, ascending, that minimise the padding, by dynamic programming over the histogram's cells.

    ``top``: the largest length in each cell, ascending; ``count, total``: rows and summed lengths. Cells are not split.
    """
    m = len(top)
    rows, sums = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    cost = np.full(m + 1, np.inf)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        new, came = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0
        for a in range(1, m + 1, 256):  # ends a..b of the last bucket against all its starts
            b = min(a + 256, m + 1)
            ends, starts = np.arange(a, b)[:, None], np.arange(0, b - 1)[None, :]
            padding = top[ends - 1] * (rows[ends] - rows[starts]) - (sums[ends] - sums[starts])
            whole = np.where(starts < ends, cost[starts] + padding, np.inf)
            came[a:b] = whole.argmin(axis=1)
            new[a:b] = whole.min(axis=1)
        back.append(came)
        cost = new
    out, at = [], m
    for came in reversed(back):
        if at == 0:
            break
        out.append(int(top[at - 1]))
        at = came[at]
    return out[::-1]


def pack_batches(spark: SparkSession, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per input row: ``<id>, n_tokens, bucket, bucket_len, batch, place, padding``.

    ``n_tokens`` is the text's words plus one end mark (null and empty texts: 1). All lengths go into one histogram of
    bounded size; its boundaries of least total padding make the buckets, numbered by length. Inside a bucket, rows in
    the order of a hash fill batches of floor(token_budget / bucket_len) rows (a longer row is a batch of its own);
    ``batch`` counts from 0 in the bucket, ``place`` in the batch, so a bucket has one batch at most that is not full.
    A row's rank is the count of the hash bins before plus its rank in its own bin: no task sorts a whole bucket. Equal
    rows are rows of their own. An empty table gives an empty result; other columns are not looked at.
    """
    stage = Stage(spark, "packing")
    sized = stage.save(df.select(F.col(id_col).alias(id_col), F.xxhash64(text_col).alias("_text_key"), (n_words(F.col(text_col)) + 1).alias("n_tokens")))
    cells = sized.groupBy(length_cell(F.col("n_tokens")).alias("cell")).agg(
        F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("total")
    )
    histogram = np.array([tuple(r)[1:] for r in cells.orderBy("cell").collect()], np.int64).reshape(-1, 3)  # bounded by length_cell
    bounds = best_boundaries(histogram[:, 0], histogram[:, 1], histogram[:, 2], buckets) or [1]
    n = int(histogram[:, 1].sum())
    bins = bins_for(n)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    rows = (
        sized.withColumn("bucket", bucket)
        .withColumn("bucket_len", F.get(limits, F.col("bucket")))
        .withColumn("_key", F.xxhash64(id_col, "_text_key", F.lit(8)))
        .withColumn("_bin", hash_bin(F.col("_key"), bins))
    )
    counts = rows.groupBy("bucket", "_bin").count()
    starts = counts.select("bucket", "_bin", (F.sum("count").over(Window.partitionBy("bucket").orderBy("_bin")) - F.col("count")).alias("_start"))
    own = Window.partitionBy("bucket", "_bin").orderBy("_key", id_col, "_text_key")
    rank = F.col("_start") + F.col("_row") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("long")
    placed = rows.withColumn("_row", F.row_number().over(own)).join(starts, ["bucket", "_bin"])
    return placed.select(
        id_col,
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(rank / capacity).cast("long").alias("batch"),
        (rank % capacity).cast("long").alias("place"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
