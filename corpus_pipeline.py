"""The corpus pipeline: from raw documents to encoded training text.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between
stages the rows are written as Parquet to the shared checkpoint folder and read
again, so a lost executor costs one stage at most.  All stages but the last
return the columns of ``documents``; each works on what the one before kept.

Defined cases are those of the operators; empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import byte_bpe, exact_dedup, jaccard, mixing, quality
from tocsin.llm.common import bounded_batches, stored
from tocsin.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is fitted on labelled rows of
    ``docs`` itself."""
    bounded_batches(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return quality.accepted(docs, labels)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    bounded_batches(spark)
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: left out, once or twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids, and the digest of its decoded bytes."""
    bounded_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the classifier; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
