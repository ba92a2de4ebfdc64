"""A training-data pipeline over documents: each stage is one operator of llm, written and read again before the next.

Rows and columns of documents go in; every stage but the last returns the same columns.
quality: rows that the rule ensemble, trained on labels, scores below 0.3 go.
dedup: of each class of near duplicates the row with the least doc_id stays.
secrets: spans of secrets in the text are replaced by their kind, n_chars follows.
mix: sources are mixed to their target weights; rows repeat and are sorted by training time.
encode: doc_id with the number of tokens, hashes of ids and decoded text, and the ids themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, jaccard, mixing, quality, secrets
from llm.tables import keep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, ids=True)


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("secrets", secrets_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: Training a model and searching near duplicates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{name}")
    return docs
