"""The queries ``opN_<name>`` and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, codes, divergence, embeddings, lines, minhash, mixing, oracles, packing, pages, quality, repeats, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark, table(spark, sf_dir, "documents")).drop("lang", "source")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(spark, docs, shingle=3, percent=85).drop("text_key")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(spark, table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out("doc_id"))
    scored = scored.withColumnsRenamed({c: c.removeprefix(toxicity.MADE) for c in scored.columns})
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "worst_score", "worst_start", "worst_end")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_strings(spark, table(spark, sf_dir, "documents")).drop("spans")


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_batches(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(spark, table(spark, sf_dir, "documents"))
    return mixed.drop("_text_key", "source")


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.assign_shards(docs, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress_vectors(spark, table(spark, sf_dir, "embeddings"))
    return coded.drop("label").withColumn("codebooks_sha256", F.lit(codes.books_digest(books)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spark, table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_role_repair": op4_role_repair,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_repeated_strings": op7_repeated_strings,
        "op8_length_packing": op8_length_packing,
        "op9_source_mixing": op9_source_mixing,
        "op10_jump_sharding": op10_jump_sharding,
        "op11_value_dictionaries": op11_value_dictionaries,
        "op12_source_divergence": op12_source_divergence,
        "op13_html_extraction": op13_html_extraction,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
