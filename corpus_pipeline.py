"""Training-corpus pipeline: language, near copies, secrets, mixture, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemledger.llm import langid, mixing, nearsets, packing, secrets
from stemledger.llm.queries import table, vocabulary
from stemledger.llm.shared import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter or without a leading language go."""
    return langid.accepted(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return nearsets.survivors(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture of their sources draws them."""
    names = [f"{c}_" if c in mixing.COLUMNS else c for c in docs.columns]  # mix replaces columns named like its own
    return mixing.mix(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every drawn document with its sequence and offset."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", secret_scan),
    ("mixture", mixture),
    ("packing", packed),
]

#: No SQL can express the language model or the tokenizer; the stages are tested one by one and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
