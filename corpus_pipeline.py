"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. language_id: documents whose language the byte network cannot tell go.
2. near_duplicates: one document of each group of near copies stays.
3. personal_data: spans are replaced by their kind in brackets.
4. mixing: every source gives the words of its target; a document may come twice, and the
   copy at a source's target ends there.
5. packing: the documents' token ids in sequences of at most 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskweave.llm import best_two_fit, circulant_minhash, langid_cnn, mixing, pii_bootstrap
from maskweave.llm.common import cut, table

#: A document stays if its language's probability reaches this; clean short texts do.
LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid_cnn.keep_known(docs, langid_cnn.fit(docs), LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return circulant_minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_bootstrap.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_two_fit.pack(docs, lean=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("packing", packing),
]

#: Learned models and hashes are in it, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
