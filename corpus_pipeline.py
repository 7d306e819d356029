"""The training-data pipeline over documents: each stage's result is written as Parquet and read as the next one's docs.

Toxicity rejects documents, near-dedup keeps one of each group, substring dedup cuts repeated passages out of texts,
the secret scan masks what it finds, and packing gives the sequences that remain. All but the last keep the columns of
documents and whatever others there are, under any names. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cutgrain.llm import minhash, packing, secrets, substrings, toxicity
from cutgrain.session import ensure_checkpoint_dir, table


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that a model of `labels` rejects. Null and empty texts have no features and stay; rows are
    independent, so null and repeated ids are kept; without labels of both classes all stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the smallest id, null ids last. Every row counts
    for itself, also where ids repeat; texts without words all stay."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one, or the same one before, has. Rows all stay, if with an
    empty text; null texts stay null, and rows with null ids lose nothing."""
    return substrings.dedup(docs, removed_col=None)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked. Rows all stay, null texts stay null, and null and repeated ids don't matter."""
    samples = secrets.default_samples(spark).union(secrets.samples_of(docs))
    return secrets.redact(docs, secrets.train(samples))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. A null or empty text is its end id alone; repeated rows are packed each."""
    # workers hold what earlier stages left in them as well, so they get small chunks and memories
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, chunk=1 << 20, memory=200_000)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The stages' tables stay in a folder of their own below spark.checkpoint.dir, which the result
    reads; the folder may go with the other checkpoints when the result has been used."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
