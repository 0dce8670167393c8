"""A training-data pipeline over ``documents``: each stage takes what the one before kept.

Language ID drops documents without a language, near-duplicate removal keeps one document of each group,
decontamination drops documents in which a benchmark item stands, the secret scan masks secrets in the text,
and byte-level BPE turns texts into token ids and back. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saldospark.llm import bpe, decontaminate, langid, secrets, simhash
from saldospark.llm.common import shared_folder
from saldospark.llm.queries import VOCABULARY

#: Text is sent to the Python workers in Arrow batches of about so many bytes. Spark's own limits (10,000 rows, 64 MB) let a batch
#: hold all text of a task, at once in the executor's native memory and in the worker, and both keep what such buffers took.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches are small; the setting holds until its result is written, ``run`` takes it back."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(*BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned; ``und`` and near-uniform ones go."""
    return langid.keep_identified(docs, langid.fit(docs))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.mask_secrets(docs, VOCABULARY)


@small_batches
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and hashes of the ids and of the decoded bytes, for each document."""
    return bpe.bpe_digest(docs, VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express a trained network, fingerprints, alignment or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH[0])
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
            docs = spark.read.parquet(f"{out}/{name}")
    finally:
        spark.conf.set(BATCH[0], before)
    return docs
