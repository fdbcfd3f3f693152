"""The corpus pipeline: toxic documents go, then copies and near copies, the rest is mixed to targets and packed.

Each stage takes all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockflow.llm import digest_index, harmonic_packing, simhash_bktree, source_mixing, toxic_segments
from stockflow.llm.common import staged, table
from stockflow.llm.queries import VOCABULARY


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels calls toxic go. Of an empty frame, nothing is left to fit or drop."""
    return toxic_segments.without_toxic(docs, toxic_segments.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return digest_index.unique_rows(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return simhash_bktree.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with probabilities that draw source, language and topic to target shares and keep ``RATE`` of the tokens."""
    return source_mixing.sampled(docs, rate=source_mixing.RATE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens.

    A null or empty text has one piece, of the end id alone; repeated rows are packed each. Of an empty frame there is none.
    """
    return harmonic_packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
