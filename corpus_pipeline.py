"""From raw documents to token counts: five stages, each one operator of ``pagequarry.llm``.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the
columns of docs (the last one returns the encoding). ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again, so a lost executor costs at most the stage at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, line_dedup, minhash_dedup, mixing, quality_classifier
from pagequarry.llm.common import bloom, bloom_hit, settle, spare, text_key


def _with_length(docs: DataFrame, names: list[str]) -> DataFrame:
    """n_chars, where docs have it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(names) if "n_chars" in names else docs.select(names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on the labelled ones outside the held-out fold, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.learn(docs, labels, ~quality_classifier.held_out())
    clash = {c: f"__{c}" for c in ("score", "predicted") if c in docs.columns}
    scored = quality_classifier.score_documents(docs.withColumnsRenamed(clash), model).where("predicted = 1").drop("score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in clash.items()}).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one that is left without a word was all copies and goes."""
    names = docs.columns
    clash = {c: f"__{c}" for c in ("n_lines", "n_removed_lines") if c in names}
    cut = line_dedup.dedup_lines(docs.withColumnsRenamed(clash))
    cut = cut.where((F.col("n_removed_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines")))
    return _with_length(cut.drop("n_lines", "n_removed_lines").withColumnsRenamed({v: k for k, v in clash.items()}), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes its words, to the nearest whole number; a document
    without words stays out. A source with words that would be left without a document by the rounding keeps the
    one of which the mixture takes the largest part."""
    names = [f"`{c}`" for c in docs.columns]
    key, n, rows_of, copy = spare(docs, "__key", "__n", "__rows", "__copy")
    part = F.col("taken") / F.col("size")
    taken = settle(mixing.mix_documents(docs).where("taken > 0").select("source", "key", part.alias("part"), F.round(part).cast("int").alias("n")), "mix-taken")
    rescued = taken.groupBy("source").agg(F.sum("n").alias("all"), F.max_by("key", F.struct("part", "key")).alias("key")).where("all = 0").select("key", F.lit(1).alias("n"))
    whole = taken.where("n > 0").select("key", "n").unionByName(rescued)
    copies = settle(whole.groupBy(F.col("key").alias(key)).agg(F.sum("n").cast("int").alias(n), F.count(F.lit(1)).alias(rows_of)), "mix-copies")
    keyed = docs.withColumn(key, text_key())
    chosen = keyed.where(bloom_hit(spark, key, bloom(copies.select(key)))).join(copies, key)
    # rows that can't be told apart share their number of copies
    rows = chosen.where(F.col(rows_of) == 1).unionByName(chosen.where(F.col(rows_of) > 1).dropDuplicates([key]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return bpe.encode_documents(docs, *bpe.default_vocabulary(), output="digest")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: No SQL expresses a learned classifier or the encoding; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
