"""A corpus clean-up pipeline: four stages over ``documents``, each written and read again by its runner.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents for all but the last one.

Defined cases, for all stages: null, empty and white-space texts are rejected by the first stage, as they have no language, and by themselves are alike, clean and encoded as no ids; very long texts are
read whole; of rows with the same id and text one stays, rows of one id with different texts and rows without an id are documents of their own; equal scores and equal groups are settled as
the operators state it; columns of any name stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palaver.llm import bpe, decontaminate, language_id, near_copies
from palaver.storage import shared_folder

#: Texts whose n-grams are less like every language's profile than this are rejected, with those that have no letter.
LEAST_LANGUAGE_SCORE = 0.2


def send_small_batches(spark: SparkSession) -> None:
    """Sets the session to send at most about 4 MB of rows to Python at once, as batches of whole texts take much memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a recognisable language."""
    send_small_batches(spark)
    return language_id.keep_identified(docs, least=LEAST_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies: fingerprints at most three bits apart, or five-word shingles with a Jaccard coefficient of 0.8 or more."""
    send_small_batches(spark)
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    send_small_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text for every kept document."""
    send_small_batches(spark)
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("near_copies", drop_near_copies), ("decontamination", drop_benchmark_leaks), ("bpe", tokenize)]

#: Shingle sets, profiles and merges are no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
