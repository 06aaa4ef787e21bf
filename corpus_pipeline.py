"""A training corpus from raw documents: five operators in a row, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import lines, minhash, mixing, packing, toxicity
from sparkloom.llm.store import Stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the sentence model rejects; it learns from the labelled rows of these documents.

    Null and empty texts score 0 and stay; repeated rows share their fate; other columns go through; no rows, no result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark, docs, labels)
    return toxicity.score_documents(docs, model).where("tox_predicted = 0").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of three lines or more; n_chars follows the text.

    Every row stays, with a null text as null. Of equal passages the first by (id, text, place) stays, so ties are
    settled; rows equal in id and text are one document. No rows, no result.
    """
    cut = lines.dedup_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links by 0.8 of the five-word shingles: that with the smallest id.

    Texts without words, null ones too, are in no group and stay; equal rows with that id all stay. No rows, no result.
    """
    return minhash.without_near_duplicates(spark, docs, shingle=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the sources to their target weights; a document of a small source may come up to three times.

    Which documents, a hash of the id says, ties the text. Texts without words are in no mix; a null source is a source.
    """
    return mixing.mixed_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and the batches in them, one row per document of the mix, repeated ones too."""
    return packing.pack_batches(spark, docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: A trained model decides in the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is a Parquet table in the shared folder."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage.save(step(spark, docs, sf_dir))
    return docs
