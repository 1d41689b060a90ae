"""The pipeline from raw documents to packed batches.

Each stage gets what the one before kept and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again.

Null, empty and repeated rows are treated as the operators' docstrings say:
toxicity keeps them (nothing speaks against them); language identification
rejects null text and text without a letter; near deduplication keeps one row of
each group, and of repeated rows; packing places every row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import langid, minhash, packing, toxicity
from glyphmill.llm.common import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chain of classifiers stays under the threshold; trained on the table labels."""
    return toxicity.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin."""
    return langid.accepted(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.one_of_each(docs, percent=80)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches inside optimal length buckets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("near_dedup", one_of_near_duplicates),
    ("packing", pack_batches),
]

#: Trained models can't be expressed in SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
