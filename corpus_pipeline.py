"""A training corpus from raw documents: five stages, each written before the next begins.

``STAGES`` lists name and function of each; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame. All but the last return the columns of
``documents``, each judged on what the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm import chain_toxicity, merge_replay, signature_tree, spaced_seeds, suffix_dedup
from urlrisk.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain calls toxic."""
    chain = chain_toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return chain_toxicity.drop_toxic(docs.select(*COLUMNS), chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar shingle sets."""
    return signature_tree.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 200-byte strings out of the texts; a text with nothing left stays, empty."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark passage."""
    return spaced_seeds.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the byte-level BPE ids of each text."""
    ranks = merge_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return merge_replay.token_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

# The first stage is a fitted model and the last a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
