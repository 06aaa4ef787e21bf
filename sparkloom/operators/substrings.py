"""Which strings are parts of which others, by grams of their words instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter terms are looked up by themselves.
GRAM = 3


def _grams(c: Column, size: int) -> Column:
    n = F.char_length(c) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def words_with(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, word`` for all words of ``vocabulary`` that contain a term of ``terms``; empty and null ones are left out.

    A word that contains a term has each of the term's grams, so a term is looked up by its rarest gram alone and what is found
    is compared. Both tables are read as sets.
    """
    asked = terms.select("term").where("term <> ''").distinct()
    kept = vocabulary.select("word").where("word <> ''").distinct()
    every = F.flatten(F.array(*[_grams(F.col("word"), k) for k in range(1, GRAM + 1)]))
    wanted = asked.select("term", F.explode(_grams(F.col("term"), GRAM)).alias("gram")).unionByName(asked.where(F.char_length("term") < GRAM).select("term", F.col("term").alias("gram")))
    own = kept.select("word", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = own.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no word has ends the search for its term
    rarest = wanted.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0")
    return own.join(rarest.select("term", F.col("m.gram").alias("gram")), "gram").where(F.contains("word", "term")).select("term", "word").distinct()


def texts_with(needles: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``needle, key`` for all texts that contain a needle (column ``needle``), which may have spaces.

    A needle is looked up by the longest of its words, which lies in one word of the text, and then compared whole.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    longest = F.array_max(F.transform(words(F.col("needle")), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    asked = needles.select("needle").where("trim(needle) <> ''").distinct().withColumn("term", longest)
    index = texts.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word")).distinct()
    met = asked.join(words_with(asked, index), "term").join(index, "word").select("needle", key).distinct()
    return met.join(texts.select(key, text).distinct(), key).where(F.contains(F.col(text), F.col("needle"))).select("needle", key).distinct()
