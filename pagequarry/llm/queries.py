"""The opN queries: thin wrappers of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, embedding_dedup, line_dedup, minhash_dedup, mixing, oracles, quality_classifier, quality_rules, suffix_dedup, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), texts=False, passage=suffix_dedup.PASSAGE)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.clean_documents(docs, texts=False).drop("text")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), *bpe.default_vocabulary(), output="digest")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _read(spark, sf_dir, "documents").select("doc_id", "text"), quality_classifier.held_out()
    model = quality_classifier.learn(docs, _read(spark, sf_dir, "labels"), ~out)
    return quality_classifier.score_documents(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _read(spark, sf_dir, "documents").select("doc_id", "text"), quality_classifier.held_out()
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"), ~out)
    return toxicity.score_documents(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_suffix_dedup, op2_quality_rules, op3_source_mixing, op4_warc, op5_byte_bpe,
        op6_quality_classifier, op7_line_dedup, op8_toxicity, op9_embedding_dedup, op10_minhash_dedup,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
