"""Native expressions on whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: the space and the control characters tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the text's words; empty for null and for texts without a word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    """Number of words, as long."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def hash_bin(key: Column, bins: int) -> Column:
    """The top bits of a 64-bit hash, so that bins are ranges of the key in unsigned order; bins is a power of two."""
    bits = bins.bit_length() - 1
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
