"""Operator 6: removal of line passages that repeat anywhere, by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES


def _worded(text: Column) -> Column:
    """``[{at, line}]``: the lines that hold a word, trimmed, with their index among all \\n-split lines."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(SPACES)).alias("line"))
    )
    return F.filter(lines, lambda x: x["line"] != "")


def _windows(worded: Column, width: int) -> Column:
    """``[{h1, h2, first, last}]``: two 64-bit hashes of each window of lines and the indexes it covers."""

    def window(i: Column) -> Column:
        own = [F.get(worded, i + k) for k in range(width)]
        lines = [x["line"] for x in own]
        return F.struct(
            F.xxhash64(*lines).alias("h1"),
            F.xxhash64(F.lit(6), *lines).alias("h2"),
            own[0]["at"].alias("first"),
            own[-1]["at"].alias("last"),
        )

    n = F.size(worded)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window))


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``df`` with repeated passages cut out of the text, plus ``n_lines``, ``n_removed``, ``n_windows_removed``.

    Windows are ``width`` consecutive lines among those that hold a word, compared without their outer white space. Of
    equal windows in the whole table the first by (id, text hash, place) stays; the lines from the first to the last of
    every later one go, overlaps once, blank lines between them too. Other lines stay as they are. Null ids come first;
    null texts stay null with 0 lines; texts with fewer lines than a window stay as they are. Rows equal in id and text
    are one document and share its fate. An empty table stays empty; columns named like the new ones are replaced.
    """
    counts = ["n_lines", "n_removed", "n_windows_removed"]
    df = df.drop(*counts)
    keyed = df.select(F.col(id_col).alias("_ld_id"), F.xxhash64(text_col).alias("_ld_text"), _worded(F.col(text_col)).alias("_ld_lines"))
    found = keyed.select("_ld_id", "_ld_text", F.inline(_windows(F.col("_ld_lines"), width)))
    place = F.struct("_ld_id", "_ld_text", "first")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("_ld_first"), F.count("*").alias("_ld_n")).where("_ld_n > 1")
    later = (
        found.join(first.select("h1", "h2", "_ld_first"), ["h1", "h2"])
        .where(~place.eqNullSafe(F.col("_ld_first")))
        .groupBy("_ld_id", "_ld_text")
        .agg(F.collect_set(F.struct("first", "last")).alias("_ld_spans"))
    )
    covered = F.array_distinct(F.flatten(F.transform("_ld_spans", lambda s: F.sequence(s["first"], s["last"]))))
    later = later.select("_ld_id", "_ld_text", F.size("_ld_spans").cast("long").alias("_ld_n"), covered.alias("_ld_gone"))
    rows = df.withColumn("_ld_hash", F.xxhash64(text_col))
    joined = rows.join(later, F.col(id_col).eqNullSafe(F.col("_ld_id")) & (F.col("_ld_hash") == F.col("_ld_text")), "left")
    lines = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    kept = [F.when(F.col("_ld_gone").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in df.columns]
    return joined.select(
        *kept,
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_ld_n", F.lit(0)).cast("long").alias("n_windows_removed"),
    )
