"""A training corpus from ``documents``: toxicity, exact copies, near copies, packing.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralog.llm import toxicity
from terralog.llm.exact_dedup import keep_first
from terralog.llm.packing import pack
from terralog.llm.simhash import keep_one
from terralog.llm.tokens import tokenizer_path
from terralog.llm.worker_memory import BATCH_ROWS, ROWS
from terralog.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more go; it learns from ``labels`` outside the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the smallest doc_id stays."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that fingerprints of five-word shingles link, the smallest doc_id of each group stays."""
    return keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("packing", pack_sequences)]

#: The classifier and the column generation have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each result written to the shared folder and read again.

    Arrow batches are set small for the session: the last stage is computed by the caller, and workers of all stages share an executor's memory with the JVM.
    """
    spark.conf.set(BATCH_ROWS, str(ROWS))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
