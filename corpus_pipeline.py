"""Documents to tokens: language, near-duplicates, benchmark copies, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept. run() writes each
stage's result as Parquet into the cluster's shared folder and reads it again as the next stage's input, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import byte_bpe, decontaminate, language_crf, secret_scan, simhash_dedup
from keyloom.llm._frames import lean_batches, remove, scratch, shared_folder, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or over four in ten trigrams that no learned language has; texts that mix learned languages stay.

    Where lang is null it becomes the language predicted; a language given stays.
    """
    lean_batches(spark)
    return language_crf.accepted(docs, language_crf.train(docs, learn=F.lit(True)), least=0.0, known=0.6, fill="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id: fingerprints at most 3 bits apart, or 0.8 of five-word shingles in common."""
    lean_batches(spark)
    return simhash_dedup.keep_one(docs, similarity=0.8, radius=3, size=3)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    lean_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), whole=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in their text gives way to a mask, and n_chars follows."""
    spans = unused("spans", docs.columns)
    found = secret_scan.scan(docs, rate=0.01, least=20, name=spans)
    some = F.size(spans) > 0
    text = F.when(some, secret_scan.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    clean = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, and whether they decode to it."""
    lean_batches(spark)
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.withColumn("decodes", same).drop("text", "decoded")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_copies", benchmark_copies), ("secrets", secrets), ("tokens", tokens)]

#: No SQL: the stages need learned weights, hashes and merges; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is removed as soon as it has been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
