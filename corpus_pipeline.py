"""A training-data pipeline over `documents`: four stages, each written as Parquet and read again as the next one's docs.

toxicity drops documents that the severity model calls toxic; near_duplicates keeps one document of each group of 5-word
shingle similarity 0.8 or more; personal_data replaces e-mail addresses, IP addresses, card and phone numbers by their kind;
packing lays the remaining documents' token ids into sequences of at most 2048.

Defined results of the stages. Null and empty texts: without features and so below the cut of toxicity, in no group of near duplicates, without personal data, one token in packing; they stay.
Very long texts are worked through whole. Ties between near duplicates go to the smallest id, then to the first row; rows without id come last.
Repeated rows: the toxicity and personal-data stages treat each as a row of its own; near duplicates keep one, as their texts are equal. An empty
table gives an empty one. Further columns, whatever their names, stay as they are up to packing, which returns pieces and their ids only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadlake.llm import near_duplicates, packing, personal, severity
from roadlake.llm.common import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a model of the labelled ones among them calls toxic; without labels of both kinds all stay."""
    return severity.keep_clean(docs, severity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 or more tie together."""
    return near_duplicates.keep_one(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every span of personal data in `text` replaced by its kind; n_chars and other columns are as they were."""
    return personal.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence, offset and ids; each id is in exactly one piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_dedup), ("personal_data", personal_data), ("packing", pack)]
#: SQL has neither the learned model nor the tokenizer; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
