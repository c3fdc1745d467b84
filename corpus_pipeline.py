"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
again as the next stage's documents. All but the last return the columns of documents as
they came (extra ones too). Nulls, empty texts, repeated rows and empty tables are handled as
each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewright.llm import packing, quality_model, rules, secret_scan, simhash
from sitewright.llm.queries import POLICY, vocabulary
from sitewright.shared import materialize, passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_model.keep_good(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return rules.keep_good(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: words in fives, similarity 0.8 or more."""
    return simhash.drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.redact(docs, vocabulary("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that fill the training sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: The classifier's fit, the shards' packing and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
